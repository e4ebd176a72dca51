"""The data behind a scheduled report: capped rows, snippets and a long table of figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.formats import format_currency, format_number, format_pct, plain
from ledgerlight.functions.text import snippet

# Rows and characters each kind of report shows.
ROW_CAPS = {"html": 50, "text": 20, "template": 100}
SNIPPET_CAPS = {"html": 300, "text": 200, "template": 500, "summary": 400}
FORECAST_POINTS = 12


def report_rows(rows: DataFrame, order: list[Column], cap: int = 50, report: str = "report_id") -> DataFrame:
    """The first ``cap`` rows of each report with its uncut row count and a note if cut.

    Counting is its own small aggregate, and the cut happens before the shuffle, so a report
    over a third of all rows moves only ``cap`` rows per task.
    """
    counts = rows.groupBy(report).agg(F.count(F.lit(1)).alias("row_count"))
    first = (rows.withColumn("row_number", F.row_number().over(Window.partitionBy(report).orderBy(*order)))
             .where(F.col("row_number") <= cap))
    note = F.when(F.col("row_count") > cap,
                  F.concat(F.lit(f"Showing first {cap} of "), F.col("row_count").cast("string"), F.lit(" rows")))
    return first.join(counts, report).withColumn("note", note)


def report_sources(hits: DataFrame, chars: int = 300) -> DataFrame:
    """Adds the cut text and the relevance as a whole percentage."""
    return (hits.withColumn("snippet", F.concat(snippet("chunk_content", chars), F.lit("...")))
            .withColumn("relevance", F.concat(plain(F.col("score") * 100, 0), F.lit("%"))))


def confidence_text(confidence: str = "confidence") -> Column:
    return F.concat(F.lit("Confidence: "), plain(F.col(confidence) * 100, 0), F.lit("%"))


def report_sections(responses: DataFrame, report: str = "report_id") -> DataFrame:
    """Figures of each response in long form: (report_id, section, ordinal, label, value_text).

    Reads npv, irr, dcf_value, payback_period, ``sensitivity`` (map of variable to values),
    ``forecast`` (array of structs date, yhat, yhat_lower, yhat_upper) and the schedule
    columns; what a response lacks gives no row.
    """
    def cell(section: str, ordinal: int, label: Column | str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(
            F.lit(section).alias("section"), F.lit(ordinal).alias("ordinal"),
            (F.lit(label) if isinstance(label, str) else label).alias("label"), value.alias("value_text")))

    def present(column: str, text: Column) -> Column:
        return F.when(F.col(column).isNotNull(), text)

    first = F.get("forecast", F.lit(0))
    single = F.array(
        cell("financial", 1, "Net Present Value", present("npv", format_currency("npv"))),
        cell("financial", 2, "Internal Rate of Return", present("irr", format_pct("irr"))),
        cell("financial", 3, "DCF Enterprise Value", present("dcf_value", format_currency("dcf_value"))),
        cell("financial", 4, "Payback Period", F.concat(F.col("payback_period").cast("string"), F.lit(" yrs"))),
        cell("forecast", 1, F.concat(F.lit("Next Period ("), first["date"], F.lit(")")),
             F.when(first.isNotNull(), format_number(first["yhat"]))),
        cell("forecast", 2, "Confidence Interval", F.when(first.isNotNull(), F.concat(
            format_number(first["yhat_lower"]), F.lit(" - "), format_number(first["yhat_upper"])))),
        cell("schedule", 1, "Name", F.col("schedule_name")),
        cell("schedule", 2, "Cron", F.col("schedule_cron")),
        cell("schedule", 3, "Recipients", F.array_join("schedule_recipients", ", ")),
        cell("schedule", 4, "Format", F.col("schedule_format")))
    points = F.transform(F.slice(F.coalesce("forecast", F.array()), 1, FORECAST_POINTS), lambda p, i: F.struct(
        F.lit("forecast_horizon").alias("section"), (i + 1).cast("int").alias("ordinal"), p["date"].alias("label"),
        F.concat(format_number(p["yhat"]), F.lit(" ["), format_number(p["yhat_lower"]), F.lit(", "),
                 format_number(p["yhat_upper"]), F.lit("]")).alias("value_text")))
    entries = F.coalesce(F.map_entries("sensitivity"), F.array())
    variables = F.transform(entries, lambda e, i: F.struct(
        F.lit("sensitivity").alias("section"), (i + 1).cast("int").alias("ordinal"),
        F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" "))).alias("label"),
        F.array_join(F.transform(e["value"], lambda v: plain(v)), ", ").alias("value_text")))
    cells = F.concat(F.filter(single, lambda c: c.isNotNull()), points, variables)
    return responses.select(report, F.explode(cells).alias("c")).select(report, "c.*")


def report_dataset(responses: DataFrame, rows: DataFrame, hits: DataFrame, row_order: list[Column], kind: str = "html") -> dict[str, DataFrame]:
    """The four tables of a batch of reports: header, rows, sources and sections."""
    header = responses.select("report_id", "question", "answer", confidence_text().alias("confidence_text"))
    return {
        "header": header,
        "rows": report_rows(rows, row_order, ROW_CAPS[kind]),
        "sources": report_sources(hits, SNIPPET_CAPS[kind]),
        "sections": report_sections(responses),
    }


def write_reports(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Each table under its own folder, in order of the report, so a report's rows are read from few files."""
    for name, table in tables.items():
        table.repartitionByRange("report_id").sortWithinPartitions("report_id").write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")
