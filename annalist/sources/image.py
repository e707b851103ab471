"""An image: one folder of sections as Parquet with a manifest, refused for a stated reason when it is damaged."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators.order import numbered

FORMAT_VERSION = 1
#: The names of the section types.
SECTIONS = {1: "vocabulary", 2: "sources", 3: "facts", 4: "documents", 5: "loci", 6: "texts", 7: "ecc", 8: "catalogue", 9: "gazetteer", 10: "place-link", 11: "candidate", 12: "attribution", 13: "relief"}
SORTED_BY = {"facts": ["subject", "from_day", "predicate"], "vocabulary": ["id"]}


#: Fixed by this engine: the words for why an image is refused.
STATUS = ("unsourced fact", "name collision", "bad manifest", "bad version", "section out of range", "short section", "size mismatch", "content hash mismatch", "missing part")


class ImageRefused(ValueError):
    """Why an image is not opened: a stable word, and what it is about."""

    def __init__(self, status: str, about: str = "") -> None:
        assert status in STATUS
        super().__init__(f"{status}: {about}" if about else status)
        self.status, self.about = status, about


def section_name(section: Column) -> Column:
    name = F.lit("unknown")
    for k, v in SECTIONS.items():
        name = F.when(section == k, v).otherwise(name)
    return name


def digest(rows: DataFrame) -> tuple[int, int]:
    """Count and an order-free sum of row hashes: it combines over partitions, unlike a chained hash."""
    hashed = rows.select(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(rows.columns)]).alias("h"))
    got = hashed.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("h") % 2147483647)), F.lit(0)).alias("s")).first()
    return got.n, got.s


def write_image(path: str, **sections: DataFrame) -> None:
    """Each section sorted within its files, and the manifest last, so that a torn write is refused.

    Facts of a source that the sources lack, and a name with two texts, refuse the whole image.
    """
    if "facts" in sections and "sources" in sections:
        known = sections["sources"].select(F.col("source_id").alias("source_ref"))
        if not sections["facts"].where("source_ref is not null").join(known, "source_ref", "left_anti").isEmpty():
            raise ImageRefused("unsourced fact")
    if "vocabulary" in sections and not sections["vocabulary"].groupBy("id").agg(F.countDistinct("text").alias("n")).where("n > 1").isEmpty():
        raise ImageRefused("name collision")
    manifest = {"format_version": FORMAT_VERSION, "sections": {}}
    spark = next(iter(sections.values())).sparkSession
    for name, rows in sections.items():
        order = [c for c in SORTED_BY.get(name, []) if c in rows.columns]
        ready = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
        ready.write.mode("overwrite").parquet(f"{path}/{name}")
        n, s = digest(spark.read.parquet(f"{path}/{name}"))
        manifest["sections"][name] = {"rows": n, "digest": s, "columns": rows.columns}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


class Image:
    """An opened image; sections it lacks are empty, those this version does not know are counted."""

    def __init__(self, spark: SparkSession, path: str, verify: bool = True) -> None:
        self.spark, self.path = spark, path
        try:
            self.manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
        except Exception as e:
            raise ImageRefused("bad manifest") from e
        if self.manifest.get("format_version") != FORMAT_VERSION:
            raise ImageRefused("bad version")
        self.skipped = [n for n in self.manifest["sections"] if n not in SECTIONS.values()]
        if verify:
            for name, said in self.manifest["sections"].items():
                self._verify(name, said)

    def _verify(self, name: str, said: dict) -> None:
        try:
            rows = self.spark.read.parquet(f"{self.path}/{name}")
        except Exception as e:
            raise ImageRefused("section out of range", name) from e
        if sorted(rows.columns) != sorted(said["columns"]):
            raise ImageRefused("short section", name)
        n, s = digest(rows)
        if n != said["rows"]:
            raise ImageRefused("size mismatch", name)
        if s != said["digest"]:
            raise ImageRefused("content hash mismatch", name)

    def has(self, name: str) -> bool:
        return name in self.manifest["sections"]

    def section(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{name}") if self.has(name) else None

    def at(self, name: str, place: int, order: list[str]) -> DataFrame:
        """The record of a section at a place from 1 in an order; none beyond its end, and none of a section it lacks."""
        rows = self.section(name)
        if rows is None or place < 1 or place > self.manifest["sections"][name]["rows"]:
            return self.spark.createDataFrame([], rows.schema if rows is not None else "place long")
        return numbered(rows, [F.col(c).asc_nulls_first() for c in order]).where(F.col("place") == place).drop("place")


def part_path(base: str, part: int) -> str:
    """Where part N of an image lies; part 0 is the image itself."""
    return base if part == 0 else f"{base}.part{part:03d}"


#: How far beyond the last part a part is looked for that would show a hole.
GAP_PROBE = 4


def parts(spark: SparkSession, base: str, probe: int = GAP_PROBE) -> list[str]:
    """The paths of an image and its parts; a hole in their numbers refuses the set."""
    jvm = spark.sparkContext._jvm

    def there(part: int) -> bool:
        where = jvm.org.apache.hadoop.fs.Path(part_path(base, part))
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    found = [base]
    while there(len(found)):
        found.append(part_path(base, len(found)))
    for ahead in range(1, probe + 1):
        if there(len(found) + ahead):
            raise ImageRefused("missing part", part_path(base, len(found)))
    return found


def union_section(spark: SparkSession, paths: list[str], name: str) -> DataFrame | None:
    """The rows of a section of several images, each opened with its checks; none if none has it."""
    rows = [image.section(name) for image in (Image(spark, p) for p in paths) if image.has(name)]
    every = rows[0] if rows else None
    for more in rows[1:]:
        every = every.unionByName(more)
    return every
