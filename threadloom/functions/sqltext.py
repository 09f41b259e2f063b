"""Facts in SQL and job text by regular expressions, as column expressions (RE2 subset)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.names import normalize_table_name

#: Words that may stand where a table's name would, and name none.
NOT_TABLES = (
    "AS", "BY", "CASE", "DATABASE", "DIRECTORY", "DUAL", "EXISTS", "IF", "JOIN", "LATERAL", "LOCAL", "NOT", "ON", "ONLY", "OVERWRITE", "PARTITION",
    "RECURSIVE", "SELECT", "SET", "TABLE", "TEMP", "TEMPORARY", "UNNEST", "USING", "VALUES", "VIEW", "WHERE", "WITH",
)
#: The layers that find_layer_names knows.
LAYERS = ("DM", "DWA", "DWD", "DWE", "DWF", "DWM", "DWO", "DWP")

# A lexer of three kinds of lexemes: names in quotes (kept), literals (emptied, a backslash quotes what follows it, and a
# doubled quote goes on) and comments (a blank). Whichever begins first wins, so none is looked for inside another.
_QUOTED_NAME = r"""("[^"]*+"|`[^`]*+`)"""
_LITERAL = r"""(')(?:[^'\\]++|\\.|'')*+('?)"""
_COMMENT = r"--[^\n]*+|/\*.*?(?:\*/|\z)"
#: What a plain pair of brackets becomes: one that holds no query and no join.
_CLOSED = "\x01"


def _phrase(words: str) -> str:
    return r"\s+".join(words.split())


def _choice(phrases: tuple[str, ...]) -> str:
    return "(?:" + "|".join(_phrase(p) for p in phrases) + ")"


def _maybe(*phrases: str) -> str:
    return rf"(?:{_choice(phrases)}\s+)?+"


def _several(*phrases: str) -> str:
    return rf"(?:{_choice(phrases)}\s+)*+"


def _name() -> str:
    """A name of the manuals: parts with dots between, each a word, or anything in double quotes, back quotes or brackets."""
    quoted = [rf"{a}[^{b}]++{b}" for a, b in (('"', '"'), ("`", "`"), (r"\[", r"\]"))]
    part = "(?:" + "|".join([r"[\p{L}_#$][\p{L}\p{N}_#$]*+", *quoted]) + ")"
    return rf"{part}(?:\s*+\.\s*+{part})*+"


#: Words between CREATE and the kind of object, in PostgreSQL, Hive, Spark and warehouse dialects.
_MODIFIERS = ("EXTERNAL", "GLOBAL", "LOCAL", "MANAGED", "MATERIALIZED", "OR ALTER", "OR REPLACE", "RECURSIVE", "SECURE", "TEMP", "TEMPORARY", "TRANSIENT", "UNLOGGED", "VOLATILE")
NAME = f"({_name()})"


def _create(kind: str) -> str:
    """One group: the modifiers."""
    return rf"\bCREATE\s+({_several(*_MODIFIERS)}){_phrase(kind)}\s+{_maybe('IF NOT EXISTS')}"


def _verb(words: str, *between: str) -> str:
    """A statement that names its object after some words of its own."""
    return rf"\b{_phrase(words)}\s+{_several(*between)}"


#: The head of each kind of statement, up to the name of what it writes.
_HEADS = {
    "INSERT": r"\bINSERT\s+" + _several("DELAYED", "HIGH_PRIORITY", "IGNORE", "LOW_PRIORITY", "OR IGNORE", "OR REPLACE") + r"(INTO|OVERWRITE)\s+" + _several("IF NOT EXISTS", "INTO", "LOCAL", "ONLY", "TABLE"),
    "CREATE_TABLE": _create("TABLE"),
    "CREATE_VIEW": _create("VIEW"),
    "CREATE_FOREIGN_TABLE": _create("FOREIGN TABLE"),
    "MERGE": _verb("MERGE INTO", "ONLY"),
    "UPDATE": _verb("UPDATE", "IGNORE", "LOW_PRIORITY", "ONLY"),
}
_OBJECTS = ("EXTERNAL TABLE", "FOREIGN TABLE", "MATERIALIZED VIEW", "TABLE", "VIEW")
_CHANGES = [_verb("DELETE FROM", "ONLY"), *(rf"\b{verb}\s+{_choice(_OBJECTS)}\s+{_several('IF EXISTS', 'ONLY')}" for verb in ("ALTER", "DROP", "TRUNCATE"))]
_uncaptured = lambda p: re.sub(r"\((?!\?)", "(?:", p)


def _sources() -> str:
    """A table reference: the first of a FROM clause, the right side of a join, or what MERGE and DELETE use.

    A name before a bracket is a function, and one before a dot or a placeholder isn't whole.
    """
    begins = {"from clause": "FROM", "joined table": "JOIN", "rows to use": "USING"}
    return rf"\b{_choice(tuple(begins.values()))}\s+{_maybe('ONLY')}{NAME}(?!\s*[(.{{{_CLOSED}])"


def _common_tables() -> str:
    """name [(columns)] AS [[NOT] MATERIALIZED] ( of a WITH clause: the first, or one after a comma."""
    columns = rf"(?:\s*\([^()]*\)|{_CLOSED})?+"
    return rf"(?:\bWITH\s+{_maybe('RECURSIVE')}|,\s*){NAME}{columns}\s+AS\s*(?:{_choice(('MATERIALIZED', 'NOT MATERIALIZED'))}\s*)?+\("


SOURCES, CTES = _sources(), _common_tables()
WRITES = "(?:" + "|".join([*map(_uncaptured, _HEADS.values()), *_CHANGES]) + ")" + NAME
_PLAIN_BRACKETS = r"\s*\((?![^()]*\b(?:SELECT|WITH|JOIN|USING|VALUES)\b)[^()]*+\)"
#: A FROM in brackets that begin no query, pairs inside left aside.
_PLAIN_FROM = r"\((?!\s*+(?:SELECT|WITH)\b)(?:[^()F]++|F(?!ROM\b)|\([^()]*+\))*+FROM\b"
#: Brackets in brackets that are folded; a FROM deeper in function calls is taken for a clause.
_DEPTH = 4


def _all(x: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), F.array().cast("array<string>"))


def mask_literals(x: Column) -> Column:
    """String literals emptied (H3): a doubled or backslash-quoted quote goes on with the literal, and quotes in names aren't literals."""
    return F.when(F.contains(x, F.lit("'")), F.regexp_replace(x, rf"(?s){_QUOTED_NAME}|{_LITERAL}", "$1$2$3")).otherwise(x)


def without_comments(x: Column) -> Column:
    """Comments outside literals and names as a blank each (H2; operators.extract.strip_comments keeps the offsets)."""
    some = F.contains(x, F.lit("--")) | F.contains(x, F.lit("/*"))
    kept = _QUOTED_NAME[1:-1] + "|" + _uncaptured(_LITERAL)
    return F.when(some, F.regexp_replace(x, rf"(?s)((?:{kept})++)|{_COMMENT}", "$1 ")).otherwise(x)


def cleaned(x: Column) -> Column:
    """What the patterns run on: no comments, empty literals, upper case, no FROM inside a function's brackets (H7).

    Which brackets are a function's is decided by what they hold: no query and no join. Where such a pair holds a FROM, all
    plain pairs are folded, the inner ones first.
    """
    lexemes = F.contains(x, F.lit("'")) | F.contains(x, F.lit("--")) | F.contains(x, F.lit("/*"))
    plain = F.when(lexemes, F.regexp_replace(x, rf"(?s){_QUOTED_NAME}|{_LITERAL}|{_COMMENT}", "$1$2$3 ")).otherwise(x)

    def folded(t: Column) -> Column:
        out = t
        for _ in range(_DEPTH):
            out = F.regexp_replace(out, _PLAIN_BRACKETS, _CLOSED)
        return F.when(t.rlike(_PLAIN_FROM), out).otherwise(t)

    return _once(F.upper(plain), folded)


def _once(value: Column, f) -> Column:
    """f(value) with the value worked out once, however often f uses it, in branches too."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _names(found: Column) -> Column:
    """Names as they compare: without quotes, brackets and white space, distinct."""
    return F.array_distinct(F.transform(found, normalize_table_name))


def _without_ctes(text: Column, names: Column) -> Column:
    """Names without those of CTEs and without ignored words."""
    others = F.array(*map(F.lit, NOT_TABLES))
    return F.when(F.contains(text, F.lit("WITH")), F.array_except(F.array_except(names, _names(_all(text, CTES))), others)).otherwise(F.array_except(names, others))


def cte_names(x: Column) -> Column:
    """H5, upper case, in order of first appearance."""
    return _names(_all(cleaned(x), CTES))


def source_tables(x: Column) -> Column:
    """H6: what FROM, JOIN and USING name, without CTEs, functions, placeholders and ignored words, distinct in order of appearance."""
    return F.coalesce(_once(cleaned(x), lambda t: _without_ctes(t, _names(_all(t, SOURCES)))), F.array().cast("array<string>"))


def all_tables(x: Column) -> Column:
    """Sources and everything written, defined or dropped, sorted and distinct."""
    return _once(cleaned(x), lambda t: F.array_sort(_without_ctes(t, _names(F.concat(_all(t, SOURCES), _all(t, WRITES))))))


def upstream_tables(x: Column, own: Column, schemas: tuple[str, ...]) -> Column:
    """Qualified sources in the given schemas, without the script's own target."""
    return F.array_except(F.filter(source_tables(x), lambda t: F.substring_index(t, ".", 1).isin(*schemas) & F.contains(t, F.lit("."))), F.array(F.upper(own)))


def statement_class(x: Column) -> Column:
    """H4: (statement_type, target, insert_mode, is_temporary) of one statement, by fixed precedence."""
    return _once(_once(cleaned(x), _heads), _classified)


def _heads(m: Column) -> Column:
    """The names and modifiers of each kind of statement that a text holds; a text without the kind's word isn't searched."""

    def get(word: str, head: str, k: int) -> Column:
        return F.when(F.contains(m, F.lit(word)), F.nullif(F.regexp_extract(m, _HEADS[head] + NAME, k), F.lit("")))

    return F.struct(
        get("INSERT", "INSERT", 2).alias("insert"),
        get("INSERT", "INSERT", 1).alias("mode"),
        get("TABLE", "CREATE_TABLE", 2).alias("create"),
        get("TABLE", "CREATE_TABLE", 1).contains("TEMP").alias("create_temp"),
        get("VIEW", "CREATE_VIEW", 2).alias("view"),
        get("VIEW", "CREATE_VIEW", 1).contains("TEMP").alias("view_temp"),
        get("MERGE", "MERGE", 1).alias("merge"),
        get("UPDATE", "UPDATE", 1).alias("update"),
        m.rlike(r"\bSELECT\b").alias("selects"),
    )


def _classified(h: Column) -> Column:
    some = lambda c: h[c].isNotNull()
    kind = (
        F.when(some("insert"), F.concat(F.lit("INSERT_"), h["mode"]))
        .when(some("create"), "CREATE_TABLE")
        .when(some("view"), "CREATE_VIEW")
        .when(some("merge"), "MERGE")
        .when(some("update"), "UPDATE")
        .when(h["selects"], "SELECT")
        .otherwise("UNKNOWN")
    )
    temporary = F.when(some("insert"), False).when(some("create"), h["create_temp"]).otherwise(h["view_temp"])
    return F.struct(
        kind.alias("statement_type"),
        normalize_table_name(F.coalesce(*[h[c] for c in ("insert", "create", "view", "merge", "update")])).alias("target"),
        F.when(some("insert"), h["mode"]).alias("insert_mode"),
        F.coalesce(temporary, F.lit(False)).alias("is_temporary"),
    )


def dynamic_target(x: Column) -> Column:
    """What kind of statement writes a name that holds a placeholder, NULL for none; such a statement gives no target."""
    hole = r"[^\s,();]*[{%]|[^\s,();]+\s*\.\s*[^\s,();]*[{%]"
    order = ("CREATE_FOREIGN_TABLE", "INSERT", "CREATE_TABLE", "CREATE_VIEW", "MERGE", "UPDATE")

    def kind_of(m: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind in reversed(order):
            out = F.when(m.rlike(f"{_HEADS[kind]}(?:{hole})"), kind).otherwise(out)
        return F.when(F.contains(m, F.lit("{")) | F.contains(m, F.lit("%")), out)

    return _once(cleaned(x), kind_of)


def has_dynamic_target(x: Column) -> Column:
    return dynamic_target(x).isNotNull()


def insert_pairs(x: Column) -> Column:
    """(target, source) pairs of INSERT INTO t (a, b) SELECT x, y FROM; plain identifiers only."""
    p = r"(?is)\bINSERT\s+INTO\s+[A-Za-z0-9_.]+\s*\(([^()]*)\)\s*SELECT\s+(.*?)\s+FROM\b"
    a, b = (F.transform(F.split(F.regexp_extract(x, p, k), ","), lambda w: F.trim(w)) for k in (1, 2))
    pairs = F.arrays_zip(a.alias("target"), b.alias("source"))
    plain = r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?$"
    return F.when(F.size(a) == F.size(b), F.filter(pairs, lambda q: q["target"].rlike(plain) & q["source"].rlike(plain))).otherwise(F.array().cast("array<struct<target: string, source: string>>"))


def dependency_list(x: Column, prefix: str = "33:") -> Column:
    """Jobs of 'a|33:b|33:c' that carry the prefix, distinct, in order."""
    items = F.transform(F.split(F.coalesce(x, F.lit("")), r"\|"), lambda w: F.trim(w))
    return F.array_distinct(F.transform(F.filter(items, lambda i: i.startswith(prefix)), lambda i: F.substring(i, len(prefix) + 1, 1 << 30)))


def layer_names(x: Column) -> Column:
    """Schema.table names of known layers, repeats kept."""
    return F.filter(F.transform(F.coalesce(F.regexp_extract_all(x, F.lit(r"\b(\w+\.\w+)\b"), F.lit(1)), F.array().cast("array<string>")), F.upper), lambda t: F.substring_index(t, ".", 1).isin(*LAYERS))


def hardcoded_dates(x: Column) -> Column:
    """Quoted valid dates from 1900 to 3000, as ISO text, sorted and distinct."""
    found = F.concat(_all(x, r"'(\d{8})'"), F.transform(_all(x, r"'(\d{4}-\d{2}-\d{2})'"), lambda d: F.replace(d, F.lit("-"), F.lit(""))))
    dates = F.transform(found, lambda d: F.try_to_timestamp(d, F.lit("yyyyMMdd")).cast("date"))
    good = F.filter(dates, lambda d: d.isNotNull() & (F.year(d) >= 1900) & (F.year(d) <= 3000))
    return F.array_sort(F.array_distinct(F.transform(good, lambda d: d.cast("string"))))


def distribution_key(x: Column) -> Column:
    """H19."""
    return F.nullif(F.trim(F.regexp_extract(x, r"(?i)DISTRIBUTE\s+BY\s+HASH\s*\(([^)]*)\)", 1)), F.lit(""))


def is_read_only(x: Column) -> Column:
    """One statement that begins with a word that only reads.

    A WITH isn't such a word, as it may head a DELETE or hold one; nor is an EXPLAIN that runs what it explains, or a SELECT that writes a
    table. Semicolons in literals, names and comments don't end a statement.
    """
    one = F.regexp_replace(F.regexp_replace(cleaned(x), _QUOTED_NAME, "X"), r"[\s;]+\z", "")
    reads = one.rlike(r"^\s*(?:SELECT|SHOW|DESC|DESCRIBE|EXPLAIN)\b") & ~F.contains(one, F.lit(";"))
    return F.coalesce(reads & ~one.rlike(r"^\s*EXPLAIN\s+\(?\s*ANALY[SZ]E\b|^\s*SELECT\b[^()]*\bINTO\s"), F.lit(False))


def is_statically_false(x: Column) -> Column:
    """C7 for plain predicates: an AND of terms of which one is FALSE or compares two unequal numbers or truth values; OR and BETWEEN prove nothing."""
    literal = r"(-?\d+(?:\.\d+)?|TRUE|FALSE)"
    value = lambda v: F.when(v.isin("TRUE", "FALSE"), v).otherwise(v.try_cast("decimal(38,10)").cast("string"))
    number = lambda v: ~v.isin("TRUE", "FALSE")

    def false(t: Column) -> Column:
        a, op, b = (F.regexp_extract(t, rf"^{literal}\s*(<>|!=|=)\s*{literal}$", k) for k in (1, 2, 3))
        alike = number(a) == number(b)
        return (t == "FALSE") | (t == "NOT TRUE") | F.when((op != "") & alike, (value(a) != value(b)) == (op == "="))

    terms = lambda p: F.transform(F.split(p, r"\bAND\b"), lambda w: F.regexp_replace(w, r"^[\s(]+|[\s)]+$", ""))
    plain = F.upper(mask_literals(x))
    # brackets that aren't of the AND itself may hold another predicate
    proves = ~plain.rlike(r"\b(?:OR|BETWEEN|SELECT|NOT\s*\()|\b(?!AND\b)[A-Z_]\w*\s*\(")
    return F.coalesce(proves & _once(plain, lambda p: F.exists(terms(p), lambda t: F.coalesce(false(t), F.lit(False)))), F.lit(False))


def job_parameter(x: Column, name: str) -> Column:
    """The value of name=... in a parameter text, up to a colon, blank or end."""
    return F.nullif(F.regexp_extract(x, rf"\b{name}=([^:\s]+)", 1), F.lit(""))


def search_tokens(text: Column, tokens: list[str], squeeze: bool = False) -> Column:
    """Every token occurs, whatever the case; with squeeze, white space doesn't count."""
    x = F.upper(text)
    if squeeze:
        x = F.regexp_replace(x, r"\s", "")
    found = F.lit(True)
    for t in tokens:
        found = found & F.contains(x, F.lit(t.upper()))
    return F.coalesce(found, F.lit(False))


def quick_tables(x: Column) -> Column:
    """Names after FROM, JOIN and USING, upper case, sorted and distinct; names with CJK characters are left out."""
    found = F.transform(_all(x, r"(?i)\b(?:FROM|JOIN|USING)\s+([\w.]+)"), F.upper)
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: ~t.rlike("[一-鿿]"))))


def created_objects(x: Column, kind: str) -> Column:
    """Names of created TABLEs, VIEWs or FUNCTIONs, sorted and distinct."""
    found = _all(x, rf"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:TEMP|TEMPORARY)\s+)?{kind}\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.$]+)")
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def defined_tables(x: Column) -> Column:
    """(name, temporary) of each table that a list of columns defines, in order; CREATE ... AS defines none."""
    pattern = F.lit(_HEADS["CREATE_TABLE"] + NAME + r"\s*\(")

    def found(t: Column) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(t, pattern, F.lit(2)).alias("name"), F.regexp_extract_all(t, pattern, F.lit(1)).alias("modifiers"))
        return F.transform(both, lambda p: F.struct(normalize_table_name(p["name"]).alias("name"), F.contains(p["modifiers"], F.lit("TEMP")).alias("temporary")))

    return F.coalesce(_once(cleaned(x), found), F.array().cast("array<struct<name: string, temporary: boolean>>"))


def altered_tables(x: Column) -> Column:
    """What ALTER TABLE changes, sorted and distinct."""
    return F.array_sort(_names(_all(cleaned(x), rf"\bALTER\s+TABLE\s+{_several('IF EXISTS', 'ONLY')}{NAME}")))


def used_functions(x: Column, known: list[str]) -> Column:
    """Which of some functions are called."""
    return F.array_compact(F.array(*[F.when(F.upper(x).rlike(rf"\b{f.upper()}\s*\("), F.lit(f.upper())) for f in sorted(known)]))


def unload_descriptor(x: Column) -> Column:
    """H22: 'target,f1,f2' as (target, n_fields, fields); a JSON array of names counts as well."""
    names = F.from_json(x, "array<string>")
    parts = F.transform(F.split(x, ","), lambda p: F.trim(p))
    items = F.coalesce(names, parts)
    return F.struct(F.upper(items[0]).alias("target"), (F.size(items) - 1).cast("long").alias("n_fields"), F.array_join(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), ",").alias("fields"))
