"""Names of tables, programs and schedule times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layers before the business layers.
TECHNICAL_SCHEMAS = ("DLO", "DWO")
#: Wrapper name spaces of program names and what they stand for in comparisons.
WRAPPERS = {
    "DWS_DM": "DM",
    "DWS_DWM": "DWM",
    "DWS_DWA": "DWA",
    "DWS_DWP": "DWP",
    "DWS_DWD": "DWD",
    "DWS_DWF": "DWF",
    "DWS_DWUPRR": "DWUPRR",
    "DWS_DWO": "DWO",
    "DWS_DLO": "DLO",
    "DLK_DLO": "DLO",
}


def normalize_table_name(x: Column) -> Column:
    """Upper case without quotes, brackets and white space."""
    return F.upper(F.translate(x, " \t\n\r\x0b\x0c\"'`[]", ""))


def canonical_name(x: Column) -> Column:
    """SCHEMA.TABLE in canonical form; NULL unless there are exactly two non-empty parts."""
    n = normalize_table_name(x)
    dot = F.instr(n, ".")
    return F.when((dot > 1) & (dot < F.length(n)) & (dot == F.length(n) - F.length(F.substring_index(n, ".", -1))), n)


def schema_of(x: Column) -> Column:
    return F.substring_index(canonical_name(x), ".", 1)


def short_name(x: Column) -> Column:
    return F.substring_index(normalize_table_name(x), ".", -1)


def is_technical(x: Column) -> Column:
    """C6."""
    return F.coalesce(schema_of(x).isin(*TECHNICAL_SCHEMAS), F.lit(False))


def is_business(x: Column) -> Column:
    """A two-part name whose schema isn't technical."""
    return F.coalesce(~schema_of(x).isin(*TECHNICAL_SCHEMAS), F.lit(False))


def comparison_name(x: Column) -> Column:
    """The canonical name with its wrapper name space replaced; applying it twice changes nothing."""
    n = canonical_name(x)
    # every wrapper is four letters and the plain name space
    return F.when(F.substring_index(n, ".", 1).isin(*WRAPPERS), F.substring(n, 5, 1 << 20)).otherwise(n)


def table_aliases(x: Column) -> Column:
    """Names under which older metadata may know a table (I2): itself, its short name, with and without DWS_, and the forms of the E layer.

    That layer's tables are DWE.X, DWS_DWE.X, DWP.DWE_X and DWE_X: each of them leads to the others.
    """
    n, s = normalize_table_name(x), short_name(x)
    plain = F.regexp_replace(n, "^DWS_", "")
    rest = F.substr(n, F.instr(n, ".") + 1)
    bare = F.regexp_replace(rest, "^DWE_", "")
    own, marked = n.startswith("DWE."), s.startswith("DWE_")
    forms = [
        F.when(n.startswith("DWS_DWE.") | own, F.concat(F.lit("DWP.DWE_"), rest)),
        F.when(n.startswith("DWS_DWE."), F.concat(F.lit("DWE."), rest)),
        F.when(own, F.concat(F.lit("DWS_DWE."), rest)),
        F.when(own, F.concat(F.lit("DWE_"), rest)),
        F.when(n.startswith("DWS_DWP.DWE_"), F.concat(F.lit("DWE_"), bare)),
        F.when(marked, F.concat(F.lit("DWS_DWE."), F.substr(s, F.lit(5)))),
        F.when(marked, F.concat(F.lit("DWE."), F.substr(s, F.lit(5)))),
    ]
    return F.array_distinct(F.array_compact(F.array(n, s, plain, F.when(n.startswith("DWS_"), n).otherwise(F.concat(F.lit("DWS_"), n)), *forms)))


def parse_program_name(x: Column) -> Column:
    """(I4) 005:<schema.table>:<step>:<suffix>: target, hint, step, suffix, diagnostics.

    Only four parts give a target; three give a hint. The target's name space is unwrapped. Steps are
    positive whole numbers; the usual suffix is 00.
    """
    text = F.trim(F.coalesce(x, F.lit("")))
    part = lambda k: F.trim(F.coalesce(F.try_element_at(F.split(text, ":"), F.lit(k)), F.lit("")))
    n = F.when(text == "", 0).otherwise(F.size(F.split(text, ":")))
    marked = F.upper(part(1)) == "005"
    name = F.when(marked, comparison_name(part(2)))
    step = F.regexp_substr(part(3), F.lit(r"^0*[1-9][0-9]{0,8}$")).cast("int")
    four = marked & (n == 4)
    say = lambda when, what: F.when(when, F.lit(f"PROGRAM_NAME_{what}"))  # noqa: E731  fixed values
    diagnostics = F.array_compact(
        F.array(
            say(~marked & (n > 0), "MARKER_INVALID"),
            say(~marked | name.isNull(), "TARGET_INVALID"),
            say(marked & (n != 4), "FORMAT_UNSUPPORTED"),
            say(marked & ((n < 4) | ((n == 4) & (part(4) == ""))), "INCOMPLETE"),
            say(n > 4, "FORMAT_INVALID"),
            say(marked & (n != 4), "STEP_MISSING"),
            say(four & name.isNotNull(), "TARGET_RESOLVED"),
            say(four & step.isNull(), "STEP_INVALID"),
            say(four & (part(4) != "") & (part(4) != "00"), "SUFFIX_NONSTANDARD"),
        )
    )
    return F.struct(
        F.when(four, name).alias("target"),
        F.when(n.isin(3, 4), name).alias("hint"),
        F.when(four, step).alias("step"),
        F.when(four, part(4)).alias("suffix"),
        diagnostics.alias("diagnostics"),
    )


def schedule_seconds(x: Column) -> Column:
    """H:MM[:SS] as seconds, NULL where it isn't a time."""
    pattern = r"^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*$"
    part = lambda k: F.regexp_extract(x, pattern, k)
    h, m = part(1).try_cast("int"), part(2).try_cast("int")
    s = F.coalesce(part(3).try_cast("int"), F.lit(0))
    return F.when(x.rlike(pattern) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)


def normalize_timestamp_text(x: Column) -> Column:
    """(I11) Text with a mandatory offset as a timestamp; offsets Z, +08, +0800, +08:00, one to six fraction digits."""
    ok = x.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}(:?\d{2})?)$")
    spread = F.regexp_replace(F.regexp_replace(x, r"([+-]\d{2})(\d{2})$", "$1:$2"), r"([+-]\d{2})$", "$1:00")
    # a date's own "-02" isn't at the end of a text with a time
    return F.when(ok, spread.try_cast("timestamp"))


def canonical_json(x: Column, most_chars: int = 1 << 20) -> Column:
    """(I12) JSON with sorted keys at every level and no blanks; NULL where it isn't JSON or is longer than most_chars."""
    parsed = F.when(F.length(x) <= most_chars, F.try_parse_json(x))
    return F.to_json(parsed)  # a variant keeps its keys sorted


def path_hash(path: Column) -> Column:
    """(I19) sha256 of the last two components of a path or address, without query or fragment."""
    return F.sha2(last_components(F.regexp_replace(path, r"[?#].*$", ""), 2), 256)


def stable_key(*parts: Column | str) -> Column:
    """sha256 of the parts joined by U+001F."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]), 256)


def source_hash(fields: dict[str, Column]) -> Column:
    """sha256 of canonical JSON: sorted keys, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def ratio(a: Column, b: Column) -> Column:
    """0.0 where the denominator is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def last_components(path: Column, n: int) -> Column:
    """The last n components of a path with any separator."""
    p = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda c: c != "")
    return F.array_join(F.slice(p, F.greatest(F.size(p) - n + 1, F.lit(1)), F.lit(n)), "/")


def line_ending(text: Column) -> Column:
    """DOS, Unix or Unknown by the first line's end."""
    first = F.substring_index(text, "\n", 1)
    return F.when(text.isNull() | ~F.contains(text, F.lit("\n")), "Unknown").when(first.endswith("\r"), "DOS").otherwise("Unix")


def has_cjk(x: Column) -> Column:
    return x.rlike("[一-鿿]")


#: Fixed value: how receiving plans begin.
RECEIVE_PREFIX = "PLAN_SA_RECV_"


def receive_namespace(plan: Column, source: Column) -> Column:
    """(I15) What stands before the source's tokens in PLAN_SA_RECV_<name space>_<source>[_...].

    NULL for another shape, an empty name space, empty tokens, or several possible places.
    """
    bare = F.regexp_extract(F.upper(plan), f"^{RECEIVE_PREFIX}(.+)$", 1)
    tokens, want = F.split(bare, "_"), F.split(F.upper(source), "_")
    n, w = F.size(tokens), F.size(want)
    at = F.filter(F.sequence(F.lit(1), F.greatest(n - w + 1, F.lit(1))), lambda i: (F.slice(tokens, i, w) == want) & (i > 1))
    good = (bare != "") & ~F.array_contains(tokens, "") & ~F.array_contains(want, "") & (F.size(at) == 1)
    return F.when(good, F.array_join(F.slice(tokens, F.lit(1), F.greatest(F.try_element_at(at, F.lit(1)) - 1, F.lit(0))), "_"))


def logical_target(x: Column) -> Column:
    """(I16) DWF.F_X, DWF_X and X are one logical target."""
    return F.regexp_replace(short_name(x), "^(DWF_|F_)", "")


def program_file_name(path: Column) -> Column:
    """(I16) The program's name: file name without ending, without leading numbers and JOB_, without _DAY or _NIGHT."""
    name = F.upper(F.regexp_replace(last_components(path, 1), r"\.[^.]*$", ""))
    bare = F.regexp_replace(F.regexp_replace(name, r"^(?:JOB_|[0-9]+_)+", ""), "^DWS_DWS_", "DWS_")
    return F.regexp_replace(bare, "_(?:DAY|NIGHT)$", "")
