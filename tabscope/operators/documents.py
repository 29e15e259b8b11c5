"""Text: table summaries, report lines, sections of report texts, JSON inside answer texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabscope.functions.bounded import column_ref
from tabscope.functions.text import number_text, strip

# Words that make a short line a section header, first match wins.
SECTION_KEYWORDS = (
    ("executive summary", "executive_summary"),
    ("data quality", "data_quality"),
    ("key findings", "key_findings"),
    ("key statistical", "key_findings"),
    ("patterns", "patterns"),
    ("relationships", "patterns"),
    ("recommendations", "recommendations"),
)
HEADER_LENGTH = 50
OPENING_SECTION = "introduction"
SAMPLE_ROWS = 10


def section_of(line: Column) -> Column:
    """The section a line opens, null for an ordinary line."""
    lowered = F.lower(strip(line))
    name = F.lit(None).cast("string")
    for keyword, section in reversed(SECTION_KEYWORDS):
        name = F.when(lowered.contains(keyword), F.lit(section)).otherwise(name)
    return F.when(F.char_length(lowered) < HEADER_LENGTH, name)


def split_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, body): every text cut at its header lines.

    Each text is cut within its own row, so nothing is shuffled. A section that comes again
    replaces the earlier one; a header with no line after it leaves no section.
    """
    lines = F.split(column_ref(text), "\n")
    marked = df.where(column_ref(text).isNotNull()).select(
        column_ref(key), lines.alias("lines_"), F.transform(lines, section_of).alias("marks_")
    )
    starts = F.filter(
        F.transform("marks_", lambda m, i: F.struct((i + 1).alias("at"), m.alias("section"))),
        lambda s: s["section"].isNotNull(),
    )
    opening = F.array(F.struct(F.lit(0).alias("at"), F.lit(OPENING_SECTION).alias("section")))
    with_starts = marked.withColumn("starts_", F.concat(opening, starts))
    last = F.size("lines_") + 1

    def cut(start: Column, i: Column) -> Column:
        until = F.coalesce(F.get(F.col("starts_"), i + 1)["at"], last)
        length = until - start["at"] - 1
        return F.struct(
            start["section"].alias("section"), i.alias("place"), length.alias("length"),
            F.when(length > 0, strip(F.array_join(F.slice("lines_", start["at"] + 1, length), "\n"))).alias("body"),
        )

    pieces = F.filter(F.transform("starts_", cut), lambda p: p["length"] > 0)
    final = F.filter(
        "pieces_",
        lambda p: ~F.exists("pieces_", lambda q: (q["section"] == p["section"]) & (q["place"] > p["place"])),
    )
    return (
        with_starts.select(column_ref(key), pieces.alias("pieces_"))
        .select(column_ref(key), F.explode(final).alias("piece_"))
        .select(column_ref(key), F.col("piece_.section").alias("section"), F.col("piece_.body").alias("body"))
    )


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value.

    The JSON reader stops after the first value. Text that ends a list early cannot also end
    an object early, so the value is whole when it stands in both.
    """
    in_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.coalesce(in_list.isNotNull() & in_object.isNotNull(), F.lit(False))


def extract_json(df: DataFrame, text: str) -> DataFrame:
    """Add ``json`` and ``parse_error``: the JSON held in an answer text.

    Code-fence lines are dropped from a text that begins with one. If the rest is not JSON,
    the part from the first opening to the last closing brace is tried.
    """
    stripped = strip(column_ref(text))
    kept_lines = F.filter(F.split(stripped, "\n"), lambda line: ~strip(line).startswith("```"))
    body = F.when(stripped.startswith("```"), F.array_join(kept_lines, "\n")).otherwise(stripped)
    prepared = df.withColumn("body_", body)
    braces = F.regexp_extract("body_", r"(?s)\{.*\}", 0)
    return (
        prepared.withColumn("json", F.when(is_json(F.col("body_")), strip(F.col("body_"))).when(is_json(braces), braces))
        .withColumn("parse_error", F.col("json").isNull())
        .drop("body_")
    )


def _one_text(lines: DataFrame, order: str, text: str, name: str) -> DataFrame:
    """Join the lines of a small table (a row per column or finding) into one text."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return lines.agg(F.array_join(F.transform(ordered, lambda x: x[text]), "\n").alias(name))


# The wording of the summary texts and report lines below.

def summary_documents(
    dataset_id: str,
    profile: DataFrame,
    dataset: DataFrame,
    sample: DataFrame | None = None,
    file_name: str = "unknown",
) -> DataFrame:
    """(id, dataset_id, type, doc): texts that describe a table, for retrieval.

    ``profile`` has a row per column and ``dataset`` one row; ``sample`` is a few rows, of
    which the first five (in the order given by their ``place`` column) are shown.
    """
    described = profile.select(
        "position",
        F.concat(
            F.lit("Column '"), F.col("column"), F.lit("': type="), F.col("detected_type"),
            F.lit(", dtype="), F.col("dtype"),
            F.when(
                F.col("mean").isNotNull(),
                F.concat(
                    F.lit(", mean="), number_text(F.col("mean")), F.lit(", min="), number_text(F.col("min")),
                    F.lit(", max="), number_text(F.col("max")),
                ),
            ).when(
                F.col("detected_type").isin("categorical", "text"),
                F.concat(F.lit(", "), F.col("n_unique").cast("string"), F.lit(" unique values")),
            ).otherwise(F.lit("")),
        ).alias("line"),
    )
    one = F.lit(1).alias("one_")
    columns = _one_text(described, "position", "line", "lines_").select("lines_", one)
    shaped = dataset.select("*", one).join(columns, "one_")
    schema_doc = F.concat(
        F.lit(f"Dataset: {file_name}\nShape: "), F.col("rows").cast("string"), F.lit(" rows x "),
        F.col("columns").cast("string"), F.lit(" columns\nColumns:\n"), F.col("lines_"),
    )
    classes = F.concat(*[
        part for kind in ("numeric", "categorical", "datetime", "text")
        for part in (F.lit(f"{', ' if kind != 'numeric' else ''}{kind}: "), F.col(f"{kind}_columns").cast("string"))
    ])
    profile_doc = F.concat(
        F.lit("Data quality: "), F.col("completeness_pct").cast("string"), F.lit("% complete, "),
        F.col("total_nulls").cast("string"), F.lit(" total nulls, "), F.col("duplicate_rows").cast("string"),
        F.lit(" duplicate rows. Type breakdown: "), classes,
    )
    docs = F.array(
        F.struct(F.lit("schema").alias("type"), schema_doc.alias("doc")),
        F.struct(F.lit("profile").alias("type"), profile_doc.alias("doc")),
    )
    result = shaped.select(F.inline(docs))
    if sample is not None:
        rows = sample.where(F.col("place") < 5).select(
            "place",
            F.concat(
                F.lit("Row "), F.col("place").cast("string"), F.lit(": "),
                F.to_json(F.struct(*[column_ref(c) for c in sample.columns if c != "place"])),
            ).alias("line"),
        )
        texts = _one_text(rows, "place", "line", "lines_").where(F.col("lines_") != "").select(
            F.lit("samples").alias("type"), F.concat(F.lit("Sample data rows:\n"), "lines_").alias("doc")
        )
        result = result.unionByName(texts)
    return result.select(
        F.concat(F.lit(f"{dataset_id}_"), F.col("type")).alias("id"),
        F.lit(dataset_id).alias("dataset_id"), "type", "doc",
    )


def report_lines(
    dataset: DataFrame,
    score: DataFrame,
    findings: DataFrame,
    takeaways: DataFrame,
    correlations: DataFrame,
    top: int = 5,
) -> DataFrame:
    """(section, line_no, text): the report, one row per line, from the small result tables."""
    one = F.lit(1).alias("one_")
    counted = findings.agg(F.count(F.lit(1)).alias("n_findings")).select("*", one)
    facts = dataset.select("*", one).join(score.select("quality_score", one), "one_").join(counted, "one_")

    def lines(section: str, source: DataFrame, first: Column | int, text: Column) -> DataFrame:
        number = F.lit(first) if isinstance(first, int) else first
        return source.select(
            F.lit(section).alias("section"), number.cast("int").alias("line_no"), text.alias("text")
        )

    summary = F.concat(
        F.lit("This dataset contains "), F.col("rows").cast("string"), F.lit(" rows and "),
        F.col("columns").cast("string"), F.lit(" columns. Overall data quality score: "),
        F.col("quality_score").cast("string"), F.lit("/100. The analysis identified "),
        F.col("n_findings").cast("string"), F.lit(" potential issues."),
    )
    complete = F.concat(
        F.lit("Completeness: "), F.col("completeness_pct").cast("string"), F.lit("% of cells contain values.")
    )
    repeated = F.concat(F.lit("Duplicate rows: "), F.col("duplicate_rows").cast("string"), F.lit("."))
    # lines of a finding stay together: a running number over the few findings, times three
    numbered = findings.withColumn("n_", F.row_number().over(Window.orderBy("title")))
    detail = numbered.select(
        "n_",
        F.posexplode(F.array(
            F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("title")),
            F.concat(F.lit("  "), F.col("description")),
            F.concat(F.lit("  Recommendation: "), F.col("recommendation")),
        )).alias("k_", "text_"),
    )
    strongest = correlations.orderBy(F.abs("correlation").desc(), "col1", "col2").limit(top).withColumn(
        "n_", F.row_number().over(Window.orderBy(F.abs("correlation").desc(), "col1", "col2"))
    )
    related = F.concat(
        F.lit("- Strong correlation between "), F.col("col1"), F.lit(" and "), F.col("col2"),
        F.lit(" (r="), number_text(F.col("correlation")), F.lit(")"),
    )
    advice = "- Address any high-severity data quality issues before further analysis."
    redundancy = "- Investigate highly correlated variables for potential redundancy."
    dedupe = "- Review and deduplicate rows if appropriate."
    parts = [
        lines("executive_summary", facts, 1, summary),
        lines("data_quality", facts, 1, complete),
        lines("data_quality", facts, 2, repeated),
        lines("data_quality", detail, (F.col("n_") - 1) * 3 + F.col("k_") + 3, F.col("text_")),
        lines("key_findings", takeaways, F.col("place"), F.concat(F.lit("- "), F.col("takeaway"))),
        lines("patterns", strongest, F.col("n_"), related),
        lines("recommendations", facts, 1, F.lit(advice)),
        lines("recommendations", facts, 2, F.lit(redundancy)),
        lines("recommendations", facts.where(F.col("duplicate_rows") > 0), 3, F.lit(dedupe)),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
