"""Names of result files, and their lookup in any folder that Spark can open."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SUFFIX = re.compile(r"L(?P<lengths>.*?)_S(?P<strategies>.*?)(?:_R(?P<count>[+-]?\d+))?", re.DOTALL)
_NOTHING = {"lengths": [], "strategies": [], "random_count": None}


def ranking_suffix(lengths: Sequence[int], strategies: Sequence[str], random_count: int | None = None) -> str:
    """``L2-3_Stop_size_R5``: sorted lengths and strategies, and the random rankings a length if given."""
    tail = "" if random_count is None else f"_R{random_count}"
    return f"L{'-'.join(str(n) for n in sorted(lengths))}_S{'-'.join(sorted(strategies))}{tail}"


def parse_ranking_suffix(suffix: str) -> dict:
    """``lengths``, ``strategies`` and ``random_count`` of a suffix; nothing where it is none.

    A suffix has one ``_S``. Lengths that are no numbers are left out as a whole.
    """
    found = _SUFFIX.fullmatch(suffix)
    if not found or "_S" in found["strategies"]:
        return dict(_NOTHING, lengths=[], strategies=[])
    numbers = found["lengths"].split("-")
    lengths = [int(x) for x in numbers] if all(re.fullmatch(r"\d+", x) for x in numbers) else []
    return {"lengths": lengths, "strategies": found["strategies"].split("-"), "random_count": None if found["count"] is None else int(found["count"])}


def listed(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Sorted paths of the files and folders in ``folder`` that match a glob, on any file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(x.getPath().toString() for x in found or [])


def find_rankings(spark: SparkSession, folder: str, graph: str, lengths: Sequence[int] = (), strategies: Sequence[str] = (), random_count: int | None = None) -> tuple[str | None, str | None]:
    """Paths of a graph's rankings and of their strategies, None where there is no file.

    With lengths and strategies the file of exactly these, else the first one by name.
    """
    suffix = ranking_suffix(lengths, strategies, random_count) if lengths and strategies else "L*_S*"
    rankings = listed(spark, folder, f"{graph}_rankings_{suffix}.json")
    if not rankings:
        return None, None
    suffix = rankings[0].rsplit("/", 1)[-1].removeprefix(f"{graph}_rankings_")
    return rankings[0], next(iter(listed(spark, folder, f"{graph}_ranking_strategies_{suffix}")), None)


def find_spreading(spark: SparkSession, folder: str, graph: str) -> list[tuple[str, float]]:
    """Paths of a graph's spreading results and their probabilities, which the names carry, rising.

    Parquet, or CSV where there is no Parquet.
    """
    for kind in ("parquet", "csv"):
        if paths := listed(spark, folder, f"{graph}_sir_p*.{kind}"):
            named = ((x, re.search(rf"_p([0-9.]+)\.{kind}$", x)) for x in paths)
            return sorted(((x, float(m[1])) for x, m in named if m), key=lambda pair: pair[1])
    return []


def rankings_of(methods: DataFrame) -> list[list[int]]:
    """The distinct rankings of a table of method results, by their names."""
    names = sorted(r["ranking"] for r in methods.select("ranking").where("ranking is not null").distinct().collect())  # a row a ranking
    return [[int(g) for g in name.split("_")] for name in names]


_COMPARISON = r"([^/]*)_r([0-9_]+)_p([0-9.]+?)(?:_betas_([^/]*))?_comparison\.(?:parquet|csv)"


def read_comparisons(spark: SparkSession, folder: str, graph: str | None = None, ranking: str | None = None, probability: float | None = None) -> DataFrame:
    """All comparison files of a folder, or of its ``sem_<n>`` folders, as one table.

    Graph, ranking, probability, beta group (``none`` without one) and noise level (null outside such a
    folder) come from the files' names; those of the arguments are looked for by name, so no other file is
    opened. Files may differ in their columns: the table has all of them. Parquet, or CSV where there is none.
    Files whose names hold no ranking are left out; a folder without any file is an error.
    """
    name = f"{graph or '*'}_r{ranking or '[0-9]*'}_p{'*' if probability is None else f'{probability:.4f}'}"
    for kind in ("parquet", "csv"):
        ends = ["_comparison"] + ([] if probability is None else ["_betas_*_comparison"])
        found = [x for sub in ("", "sem_*/") for end in ends for x in listed(spark, folder, f"{sub}{name}{end}.{kind}")]
        found = [x for x in found if re.fullmatch(_COMPARISON, x.rsplit("/", 1)[-1])]
        if found:
            rows = spark.read.option("mergeSchema", "true").parquet(*found) if kind == "parquet" else spark.read.csv(found, header=True, inferSchema=True)
            break
    else:
        raise FileNotFoundError(f"no comparison files in {folder}")
    at = F.col("_metadata.file_path")
    of = lambda k: F.regexp_extract(at, f"/{_COMPARISON}", k)
    level = F.regexp_extract(at, r"/sem_(\d+)/[^/]*(?:/[^/]*)?$", 1)
    made = {"graph_name": of(1), "ranking": of(2), "infection_prob": of(3).cast("double"), "betas_group": F.when(of(4) == "", "none").otherwise(of(4)), "sem": F.nullif(level, F.lit("")).cast("int")}
    # Spark's own writer makes a folder of a file: the name is then the folder's.
    return rows.select("*", *[x.alias(f"_{c}") for c, x in made.items()]).drop(*made).withColumnsRenamed({f"_{c}": c for c in made})
