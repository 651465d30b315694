"""Frequency of every distinct term over the whole collection (problem 6).

Recursive radix spilling: rows are reduced to one for each (term, record) and written to the shared folder by the
top bits of the term's hash; all partitions above ``leaf_rows`` rows are written again by the next bits until every leaf
is small enough or holds one hash only. Each leaf is then aggregated on its own, out of core, by DuckDB.
"""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from granthika.session import scratch_path

BITS = 4
LEVELS = 64 // BITS
_LEAF = "leaf string, term string, total long, records long"


def clean_term(term: F.Column) -> F.Column:
    """Lower case, trimmed, white space of any kind as one space; null and blank terms give null."""
    spaced = F.trim(F.regexp_replace(F.lower(term), r"[\s\p{Z}\x1c-\x1f\x85]+", " "))
    return F.when(spaced != "", spaced)


def _prefix(level: int) -> F.Column:
    """The bits of the hash that tell the partitions of a level apart, those of all levels above included."""
    return F.hex(F.shiftrightunsigned("h", 64 - BITS * (level + 1)))


def radix_leaves(spark: SparkSession, rows: DataFrame, leaf_rows: int) -> list[str]:
    """Write ``rows`` (with the hash ``h``) by hash bits, all oversized partitions together by further bits; the leaves' paths.

    A level is one write and one count, however many partitions it has.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("prefix", T.StringType())])
    part, leaves = rows, []
    for level in range(LEVELS):
        path = scratch_path(spark, f"radix-{level}")
        part.withColumn("prefix", _prefix(level)).write.partitionBy("prefix").parquet(path)
        written = spark.read.schema(schema).parquet(path)
        sizes = written.groupBy("prefix").agg(F.count("*").alias("n"), (F.min("h") < F.max("h")).alias("several")).collect()
        large = [r.prefix for r in sizes if r.n > leaf_rows and r.several and level + 1 < LEVELS]
        leaves += [f"{path}/prefix={r.prefix}" for r in sizes if r.prefix not in set(large)]
        if not large:
            break
        part = written.where(F.col("prefix").isin(large)).drop("prefix")
    return leaves


def _aggregate(scratch: str, memory_mb: int):
    """DuckDB over each leaf; it spills to a folder of its own in ``scratch``, or not at all where that is no mounted path."""
    mounted = scratch.startswith("file:") or "://" not in scratch
    folder = scratch.removeprefix("file://").removeprefix("file:")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        from pyarrow import dataset, fs

        for batch in batches:
            for leaf in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(leaf if "://" in leaf or leaf.startswith("file:") else "file://" + leaf)
                found = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
                rows = dataset.dataset(found, filesystem=system, format="parquet")
                own = f"{folder}/{uuid.uuid4().hex}" if mounted else ""
                con = duckdb.connect(config={"memory_limit": f"{memory_mb}MB", "threads": 1, "preserve_insertion_order": False, "temp_directory": own})
                try:
                    con.register("rows", rows)
                    reader = con.sql("select term, sum(total)::bigint as total, count(record)::bigint as records from rows group by term").to_arrow_reader(50_000)
                    for out in reader:
                        yield pa.RecordBatch.from_arrays([pa.array([leaf] * out.num_rows, pa.string()), *out.columns], ["leaf", "term", "total", "records"])
                finally:
                    con.close()
                    if own:
                        shutil.rmtree(own, ignore_errors=True)

    return run


def term_frequencies(
    rows: DataFrame,
    *,
    id_col: str = "id",
    record_col: str = "book_id",
    term_col: str = "source_term",
    count_col: str = "frequency",
    order_col: str = "updated_at",
    rare_below: int = 3,
    common_above: float = 0.25,
    leaf_rows: int = 2_000_000,
    memory_mb: int = 512,
) -> DataFrame:
    """One row for each distinct term: term, total, records, rare, common.

    Rows with the same id count once, as their last by ``order_col`` (nulls first; among equals the greatest term,
    record and count); rows without id each count. A null count is 0. A null or blank term is no term; a null record
    adds to the total but is no record. ``rare``: total under ``rare_below``; ``common``: in more than ``common_above``
    of all distinct records of the table. An empty table gives no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    base = rows.select(
        F.col(id_col).alias("id"), clean_term(F.col(term_col)).alias("term"), F.col(record_col).cast("string").alias("record"),
        F.coalesce(F.col(count_col), F.lit(0)).cast("long").alias("n"), F.col(order_col).alias("at"),
    )
    last = base.where("id is not null").groupBy("id").agg(F.max(F.struct("at", "term", "record", "n")).alias("r")).select("r.term", "r.record", "r.n")
    once = last.unionByName(base.where("id is null").select("term", "record", "n")).where("term is not null")
    reduced = once.groupBy("term", "record").agg(F.sum("n").alias("total")).withColumn("h", F.xxhash64("term"))
    all_records = rows.agg(F.count_distinct(record_col)).first()[0]
    leaves = radix_leaves(spark, reduced, leaf_rows)
    if not leaves:
        return spark.createDataFrame([], "term string, total long, records long, rare boolean, common boolean")
    paths = spark.createDataFrame([(x,) for x in leaves], "leaf string").repartition(len(leaves))
    counted = paths.mapInArrow(_aggregate(scratch_path(spark, "radix-spill"), memory_mb), _LEAF)
    return counted.select(
        "term", "total", "records", (F.col("total") < rare_below).alias("rare"), (F.col("records") > common_above * all_records).alias("common")
    )


def marked_terms(frequencies: DataFrame) -> DataFrame:
    """(term, mark), a row for each mark of each term of ``term_frequencies``."""
    marks = F.array_compact(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))))
    return frequencies.select("term", F.explode(marks).alias("mark"))
