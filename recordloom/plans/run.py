"""The whole job: sources to clean, merged, unique and scored records."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import clean, dedup, merge, quality, validate
from recordloom.plans.linkage import ORDER, exact_members, merge_and_fold
from recordloom.sinks import export as sinks
from recordloom.sinks.snapshots import Stages, cut, fingerprint, new_run_id, scratch
from recordloom.sources.pages import page_records
from recordloom.sources.responses import landed_order, landed_records, observed, read_or_empty, typed_records
from recordloom.sources.selectors import DETAIL_SELECTORS


@dataclass
class Result:
    """What a run returns. ``records`` can be sorted and ranked by ``merge_order``."""

    success: bool
    records: DataFrame | None = None
    duplicates: Callable[[], DataFrame] | None = None  # every pair of hot keys, so only on request
    statistics: DataFrame | None = None
    output_path: str | None = None
    total_records: int = 0
    error: str | None = None
    run_id: str = ""
    source_errors: dict[str, str] = field(default_factory=dict)
    drop: Callable[[], None] = lambda: None  # removes the run's stages; its frames can't be read afterwards


def prepare(df: DataFrame, strict: bool = False) -> DataFrame:
    """Valid rows, in their types, money as numbers, cleaned: one projection over the scan."""
    valid = typed_records(validate.keep_valid(df, strict))
    return clean.clean_records(clean.coerce_money(valid, ["assessed_value", "sale_price"]))


def link(left: DataFrame, right: DataFrame, order: str = "rec_idx", **matching) -> tuple[DataFrame, DataFrame]:
    """(records, fuzzy members) of two prepared sources.

    Keys with several rows are folded without forming pairs; the fuzzy phase
    sees only the rows that are alone with their key. The records have their place
    in the merged order as ``merge_order``, a folded one that of its first row.
    """
    single, folded = merge_and_fold(left, right, order=order)
    tagged = cut(dedup.find_duplicates(single, ORDER, use_exact=False, **matching), "tagged")
    collapsed = dedup.collapse_groups(tagged, ORDER)
    unique = tagged.filter(F.col(dedup.GROUP).isNull()).drop(dedup.GROUP, dedup.KIND)
    records = unique.unionByName(collapsed, allowMissingColumns=True).unionByName(folded)
    return records, tagged.filter(F.col(dedup.GROUP).isNotNull())


def _two(frames: dict[str, DataFrame]) -> list[DataFrame]:
    """Both sides of the merge; a single source has an empty partner."""
    some = list(frames.values())
    if not 1 <= len(some) <= 2:
        raise ValueError(f"one or two sources, not {len(some)}")
    return some if len(some) == 2 else [some[0], some[0].limit(0)]


def run_statistics(
    sources: dict[str, DataFrame],
    cleaned: dict[str, DataFrame],
    records: DataFrame,
    counted_before: list[tuple[str, str, str]] = (),
) -> DataFrame:
    """Counts of every stage as (section, key, value); ``counted_before`` are rows that
    were counted while stages were written."""
    left, right = _two(cleaned)
    counted = validate.validation_counts(sources)
    stages = [
        counted.select(
            F.lit("validation").alias("section"),
            F.explode(
                F.array(
                    F.struct(F.concat("origin", F.lit("_valid")).alias("k"), F.col("valid").alias("v")),
                    F.struct(F.concat("origin", F.lit("_invalid")).alias("k"), F.col("invalid").alias("v")),
                )
            ).alias("p"),
        ).select("section", F.col("p.k").alias("key"), F.col("p.v").cast("string").alias("value"))
    ]
    merged = merge.merge_counts(left, right)
    stages.append(sinks.long_statistics("merging", merged))

    members = F.sum(F.col("duplicate_count").cast("decimal(38,0)"))
    grouped = records.agg(
        merge.count_of(F.coalesce(members, F.lit(0))).alias("members"),
        F.count("duplicate_count").alias("groups"),
        F.count("*").alias("out"),
    )
    rows_in = F.col("members").cast("decimal(38,0)") + F.col("out") - F.col("groups")
    dedup_row = grouped.select(
        merge.count_of(rows_in).alias("input_records"),
        F.col("out").alias("unique_records"),
        F.col("members").alias("duplicates_removed"),
        (F.col("members") - F.col("groups")).alias("rows_removed"),
        F.col("groups").alias("duplicate_groups"),
    )
    stages.append(sinks.long_statistics("deduplication", dedup_row))
    stages.append(sinks.long_statistics("enrichment", quality.quality_distribution(records)))
    if counted_before:
        stages.append(records.sparkSession.createDataFrame(list(counted_before), "section string, key string, value string"))
    out = stages[0]
    for s in stages[1:]:
        out = out.unionByName(s)
    return out


def _source_counts(name: str, counts: dict) -> list[tuple[str, str, str]]:
    """Rows of the statistics; zeros for a source of which nothing was written."""
    keys = ("total_records", "successful_extractions", "failed_extractions")
    return [("fetching", f"{name}_{key}", str(counts.get(key, 0))) for key in keys]


def run(
    spark: SparkSession,
    sources: dict[str, Callable[[], DataFrame]],
    output_path: str | None = None,
    output_format: str = "csv",
    snapshots: bool = False,
    order: str = "rec_idx",
    limits: dict[str, int] | None = None,
    resume: str | None = None,
    **matching,
) -> Result:
    """Run all stages over one or two sources (name to a function that reads it).

    Every source is read once, into a written table: by itself, so a source that
    fails, also while its rows are read, counts as empty and leaves the other one's
    records. ``limits`` cuts a source to its first rows in ``order``. Any later error
    ends the run with ``success`` false and its text.

    The stages are written under the run id, with a manifest; ``resume`` goes on with the
    run of that id: stages that are complete, from the same files and options, are read
    again. Tables between the stages are dropped at the end. With ``snapshots`` the stages
    are kept; without, they are dropped if the run fails, and else by ``Result.drop``.
    """
    run_id, started = resume or new_run_id(), time.monotonic()
    stages = Stages(spark, run_id)
    counted: list[tuple[str, str, str]] = []

    def fetched(name: str, prints: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
        most = (limits or {}).get(name)

        def keep(df: DataFrame) -> DataFrame:
            prints[name] = fingerprint(spark, df, most, order)
            some = df if most is None else df.orderBy(order).limit(most)
            table, counts = stages.counted(f"01_fetched_{name}", prints[name], lambda: observed(some, f"fetched_{name}_{run_id}"))
            counted.extend(_source_counts(name, counts))
            return table

        return keep

    def cleaned_rows(name: str, df: DataFrame, source: str) -> DataFrame:
        seen = Observation(f"cleaned_{name}_{run_id}")
        make = lambda: (prepare(df).observe(seen, F.count(F.lit(1)).alias("cleaned_records")), seen)
        table, counts = stages.counted(f"02_cleaned_{name}", source, make)
        counted.extend(("cleaning", f"{name}_{key}", str(value)) for key, value in counts.items())
        return table

    try:
        with scratch(spark):
            frames, errors, prints = {}, {}, {}
            for name, read in sources.items():
                df, error = read_or_empty(spark, read, fetched(name, prints))
                if error:
                    errors[name] = error
                    counted.extend(_source_counts(name, {}))
                frames[name] = df
            # A source that failed has the order column of the other one.
            known = [df.schema[order].dataType for df in frames.values() if order in df.columns]
            for name in errors:
                frames[name] = frames[name].withColumn(order, F.lit(None).cast(known[0] if known else "bigint"))
                prints[name] = f"failed: {known}"
            cleaned = {name: cleaned_rows(name, df, prints[name]) for name, df in frames.items()}
            left, right = _two(cleaned)
            source = repr((sorted(prints.items()), sorted(matching.items())))
            linked: list[DataFrame] = []

            def of_link(k: int) -> DataFrame:
                if not linked:
                    linked.extend(link(left, right, order, **matching))
                return linked[k]

            folded = stages.table("03_deduplicated", source, lambda: of_link(0))
            fuzzy_members = stages.table("03_fuzzy_members", source, lambda: of_link(1))
            scored = stages.table("04_enriched", source, lambda: quality.score_records(folded))
            total = scored.count()

            def duplicates() -> DataFrame:
                fuzzy = fuzzy_members.drop(dedup.GROUP, dedup.KIND)
                return exact_members(left, right, order=order).unionByName(fuzzy).drop(ORDER)

            def statistics() -> DataFrame:
                seconds = f"{time.monotonic() - started:.3f}"
                more = [("export", "exported_records", str(total if output_path else 0)), ("run", "duration_seconds", seconds)]
                return run_statistics(frames, cleaned, scored, [*counted, *more])

            path = None
            if output_path:
                parts, exported = None, scored.drop(ORDER)
                if output_format == "report":
                    parts = sinks.report_parts(exported, left.drop(order), right.drop(order), duplicates(), statistics())
                path = sinks.export(exported, output_path, output_format, parts)
        return Result(True, scored, duplicates, statistics(), path, total, None, run_id, errors, stages.drop)
    except (PySparkException, Py4JJavaError, ValueError) as e:
        if not snapshots:
            stages.drop()
        return Result(False, error=str(e), run_id=run_id)


def run_landed(
    spark: SparkSession,
    responses: str,
    pages: Callable[[], DataFrame],
    selectors: dict[str, list[str]] = DETAIL_SELECTORS,
    source_url: str = "",
    extracted_at: Column | None = None,
    **options,
) -> Result:
    """The whole job from what was landed: response files below a path, and pages
    (page_id, url, html). Each source is read by itself; one that can't be read
    counts as empty and is named in ``source_errors``. ``options`` go to ``run``.
    """

    def from_pages() -> DataFrame:
        records = page_records(pages(), selectors, extracted_at=extracted_at)
        return records.withColumn("landed", landed_order(F.lit(""), F.col("page_id"))).drop("page_id")

    sources = {
        "responses": lambda: landed_records(spark, responses, source_url=source_url, extracted_at=extracted_at),
        "pages": from_pages,
    }
    return run(spark, sources, order="landed", **options)


def ranked(result: Result, n: int | None = None) -> DataFrame:
    """The records of a run with ``quality_rank``; ``n`` of them, the best ones, if given."""
    if result.records is None:
        raise ValueError(f"the run has no records: {result.error}")
    if n is not None:
        return quality.add_rank(quality.top_quality(result.records, n, ORDER), ORDER)
    return quality.add_rank(result.records, ORDER)
