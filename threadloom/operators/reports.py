"""Rules for reports, their menus and authorities (Q8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import sqltext
from threadloom.functions.tables import bounded, store
from threadloom.operators.metadata import containing

#: The parts of a report file that rules look at; attributes have an underscore.
REPORT = """TableDataMap struct<TableData: array<struct<_name: string, Connection: struct<DatabaseName: string>, Query: string>>>,
    Report array<struct<_name: string, _class: string>>, ReportParameterAttr struct<_showWindow: string>, LayerReportAttr struct<_clientPaging: string, _engineState: string>"""
#: The class of a sheet, and what the first and second field of a menu line must hold or mustn't.
SHEET = "com.fr.report.worksheet.WorkSheet"
ROOT, SUFFIXES = "数据仓库/", (".cpt", ".frm")
FORBIDDEN = {
    "path": ("(村镇银行发展部)", "会计结算部", "会计部报表", " "),
    "menu": ("数据仓库/", "会计结算部", "会计部报表", "互联网金融部", "（村镇银行发展部）", ".cpt", " "),
}


def read_reports(reports: DataFrame, key: str = "report", xml: str = "xml") -> DataFrame:
    """(key, sources, sheets, paging, script): of each report its databases, sheet names, paging engine and the text of all its queries.

    The XML is read by Spark with the schema of what is wanted; text that is no XML gives nulls. Paging is NONE, NEW or ROW.
    """
    parsed = reports.select(key, F.from_xml(F.col(xml), REPORT, {"rowTag": "WorkBook"}).alias("r"))
    tables = F.coalesce(F.col("r.TableDataMap.TableData"), F.array())
    sheets = F.filter(F.coalesce(F.col("r.Report"), F.array()), lambda s: s["_class"] == SHEET)
    paged = F.col("r.LayerReportAttr._clientPaging") == "true"
    paging = F.when(paged & (F.col("r.LayerReportAttr._engineState") == "1"), "ROW").when(paged, "NEW").otherwise("NONE")
    present = F.col("r").isNotNull() & F.greatest(F.col("r.TableDataMap").isNotNull(), F.col("r.Report").isNotNull())
    return parsed.select(
        key,
        F.when(present, F.array_sort(F.array_distinct(F.array_compact(F.transform(tables, lambda t: t["Connection"]["DatabaseName"]))))).alias("sources"),
        F.when(present, F.transform(sheets, lambda s: s["_name"])).alias("sheets"),
        F.when(present, paging).alias("paging"),
        F.when(present, F.array_join(F.array_compact(F.transform(tables, lambda t: t["Query"])), "\n")).alias("script"),
    )


def dictionary_hits(rows: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, field, keywords): fields of a dictionary (field, keyword) of which a text holds some keyword, in any case, with those found.

    Texts meet keywords by pieces that both have (containing), so a dictionary of any size costs one join. Keys are unique.
    """
    words = dictionary.where("keyword <> ''").select("field", F.upper("keyword").alias("pattern"), "keyword").distinct()
    found = containing(rows, key, text, words.select("pattern").distinct())
    return found.join(bounded(words, 100), "pattern").groupBy(key, "field").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))


def report_issues(reports: DataFrame, key: str = "report", xml: str = "xml") -> DataFrame:
    """(key, rule, detail): problems of a report's name and of the text of its queries; key is the report's path."""
    read = store(read_reports(reports, key, xml), "reports")
    plain = F.upper(F.regexp_replace("script", r"\s", ""))
    name = F.substring_index(key, "/", -1)
    dates = sqltext.hardcoded_dates(F.col("script"))
    # a name without a schema, unless a WITH defines it
    bare = F.filter(sqltext.source_tables(F.col("script")), lambda t: ~F.contains(t, F.lit(".")))
    said: list[tuple[str, Column, Column]] = [
        ("NUMBER_MISSING", ~(F.contains(name, F.lit("[")) & F.contains(name, F.lit("]"))), name),
        ("NAME_WITH_BLANK", F.contains(F.col(key), F.lit(" ")), F.col(key)),
        ("NO_XML", F.col("script").isNull(), F.lit(None)),
        ("DISTINCT", F.upper("script").rlike(r"\bDISTINCT\b"), F.lit(None)),
        ("HARDCODED_DATE", F.size(dates) > 0, F.array_join(dates, ",")),
        ("EQUALS_SUBQUERY", F.contains(plain, F.lit("=(SELECT")), F.lit(None)),
        ("IN_SUBQUERY", F.contains(F.replace(plain, F.lit("JOIN(SELECT"), F.lit("")), F.lit("IN(SELECT")), F.lit(None)),
        ("END_DATE_OVERLAP", F.contains(plain, F.lit(".END_DT>=")), F.lit(None)),
        ("DATE_CONVERSION", F.contains(plain, F.lit("D_DATE=TO_DATE('")) | F.contains(plain, F.lit("D_DATE=DATE'")), F.lit(None)),
        ("SCHEMA_MISSING", F.size(bare) > 0, F.array_join(F.array_sort(bare), ",")),
    ]
    all_ = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))) for rule, bad, detail in said]))
    return read.select(key, F.explode(all_).alias("x")).select(key, "x.*")


def entry_name(x: Column) -> Column:
    """A report's name as menus and authorities have it: the last part of a path, without ending, mark and outer blanks."""
    text = F.trim(F.replace(F.regexp_replace(F.coalesce(x, F.lit("")), "[﻿\r\n]", ""), F.lit("，"), F.lit(",")))
    return F.trim(F.regexp_replace(F.substring_index(text, "/", -1), r"\.(cpt|frm)$", ""))


def menu_issues(lines: DataFrame, key: str = "line_id", line: str = "line") -> DataFrame:
    """(key, field, rule, detail): problems of menu lines 'path,menu': parts that must be there and parts that mustn't."""
    parts = F.split(F.replace(F.col(line), F.lit("，"), F.lit(",")), ",")
    fields = {"path": parts[0], "menu": F.try_element_at(parts, F.lit(2))}
    said = [
        F.when(~F.contains(fields["path"], F.lit(ROOT)), F.struct(F.lit("path").alias("field"), F.lit("ROOT_MISSING").alias("rule"), F.lit(ROOT).alias("detail"))),
        F.when(~F.contains(fields["path"], F.lit(SUFFIXES[0])) & ~F.contains(fields["path"], F.lit(SUFFIXES[1])), F.struct(F.lit("path").alias("field"), F.lit("SUFFIX_MISSING").alias("rule"), F.lit(",".join(SUFFIXES)).alias("detail"))),
        F.when(fields["menu"].isNull(), F.struct(F.lit("menu").alias("field"), F.lit("MENU_MISSING").alias("rule"), F.lit(None).cast("string").alias("detail"))),
    ]
    for field, words in FORBIDDEN.items():
        said += [F.when(F.contains(fields[field], F.lit(w)), F.struct(F.lit(field).alias("field"), F.lit("FORBIDDEN_PART").alias("rule"), F.lit(w).alias("detail"))) for w in words]
    return lines.where(F.col(line).isNotNull()).select(key, F.explode(F.array_compact(F.array(*said))).alias("x")).select(key, "x.*")


def authority_issues(lines: DataFrame, roles: DataFrame, names: DataFrame, key: str = "line_id", line: str = "line") -> DataFrame:
    """(key, rule, detail): roles and reports of authority lines 'report,role,role' that roles (role) and names (name) don't have.

    Two anti joins; names are held against each other as entry_name() gives them.
    """
    text = F.trim(F.replace(F.col(line), F.lit("，"), F.lit(",")))
    split = store(lines.where(text != "").select(key, entry_name(F.split(text, ",")[0]).alias("report"), F.filter(F.transform(F.slice(F.split(text, ","), 2, 1 << 20), lambda r: F.trim(r)), lambda r: r != "").alias("roles")), "authorities")
    asked = split.select(key, F.explode(F.array_distinct("roles")).alias("role"))
    unknown = asked.join(bounded(roles.select("role").distinct()), "role", "left_anti").select(key, F.lit("ROLE_UNKNOWN").alias("rule"), F.col("role").alias("detail"))
    known = names.select(entry_name(F.col("name")).alias("report")).where("report <> ''").distinct()
    missing = split.where("report <> ''").join(bounded(known), "report", "left_anti").select(key, F.lit("REPORT_UNKNOWN").alias("rule"), F.col("report").alias("detail"))
    return unknown.unionByName(missing)
