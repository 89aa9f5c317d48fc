"""Items that appear together: a persistent table of pair counts, kept up to date from changed baskets."""

from __future__ import annotations

import copy
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainspark.columns import q, require

#: Items of one basket that meet in one group; larger baskets are split into blocks of items.
BLOCK = 256
#: Rows that a bucket of a part has at first, about; a bucket is written in files of as many rows at most.
BUCKET_ROWS = 4_000_000
PARTS = {"baskets": "basket string, item string", "pairs": "a string, b string, n bigint", "items": "item string, n bigint"}


def pair_deltas(changes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a``, ``b``, ``d``: the signed change of each pair's count (a < b), from rows ``basket``, ``item``,
    ``s`` (1 added, -1 removed, 0 kept) of changed baskets.

    A pair of two kept items, or of an added and a removed one, doesn't change. A basket of more than
    ``block`` items is split by hash into blocks, and each two blocks of it meet on their own, so no
    group holds more than about twice ``block`` rows, whatever the basket's size.
    """
    size = changes.groupBy("basket").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("nb"), F.max(F.abs("s")).alias("any")).where("any > 0")
    rows = changes.join(size.withColumnRenamed("basket", "of"), F.col("basket") == F.col("of"))
    mine = F.pmod(F.xxhash64("item"), F.col("nb")).cast("int")
    rows = rows.select("basket", "item", "s", mine.alias("k"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
    groups = rows.groupBy("basket", F.least("k", "j").alias("p"), F.greatest("k", "j").alias("r")).agg(F.sort_array(F.collect_list(F.struct("item", "k", "s"))).alias("m"))
    # Two items meet in the group of their two blocks: in a block's own group, or across two blocks.
    met = F.expr(
        "flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> (p = r OR x.k <> y.k) AND sign(x.s + y.s) <> 0), "
        "y -> named_struct('a', x.item, 'b', y.item, 'd', CAST(sign(x.s + y.s) AS INT)))))"
    )
    return groups.select(F.inline(met)).groupBy("a", "b").agg(F.sum("d").alias("d")).where("d <> 0")


class PairTable:
    """Counts of baskets by pair and by item, in hash buckets under ``path``, one version for each batch.

    A batch rewrites only the buckets that its deltas touch, in a new folder; the manifest, written
    last, names the version of each bucket, so a batch that fails leaves the table as it was, also in this
    object, and can be given again. Of two writers of one batch the second raises RuntimeError.

    Each part has its own number of buckets: ``buckets`` at least, and as many as its first rows need at
    ``BUCKET_ROWS`` each. A part that has grown past twice that is split when a batch ends: its number of
    buckets is doubled until it fits, so neither a bucket nor the number of writing tasks is fixed.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.bucket_rows = spark, path.rstrip("/"), bucket_rows
        self.manifest = self._load() or {"batch": 0, "baskets": 0, "buckets": dict.fromkeys(PARTS, buckets), "rows": dict.fromkeys(PARTS, 0), "at": {p: {} for p in PARTS}}

    def _fs(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _load(self) -> dict | None:
        fs, folder = self._fs(f"{self.path}/manifest")
        if not fs.exists(folder):
            return None
        name = max((s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().isdigit()), key=int, default=None)
        if name is None:
            return None
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/manifest/{name}").collect()))

    def _save(self, manifest: dict) -> None:
        """The manifest of a new batch; RuntimeError if that batch is there already."""
        name = f"{self.path}/manifest/{manifest['batch']}"
        fs, temporary = self._fs(f"{name}.{uuid.uuid4().hex}.tmp")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = self._fs(name)[1]
        if fs.exists(target) or not fs.rename(temporary, target):
            fs.delete(temporary, False)
            raise RuntimeError(f"batch {manifest['batch']} was written by another writer: open the table anew")

    def _read(self, part: str, only: set[int] | None = None) -> DataFrame:
        at = self.manifest["at"][part]
        paths = [f"{self.path}/{part}/v={v}/bucket={b}" for b, v in at.items() if only is None or int(b) in only]
        return self.spark.read.schema(PARTS[part]).parquet(*paths) if paths else self.spark.createDataFrame([], PARTS[part])

    def _bucket(self, part: str, *cols: str):
        return F.pmod(F.xxhash64(*cols), F.lit(self.manifest["buckets"][part])).cast("int")

    def _size(self, part: str, rows: int) -> None:
        """Before a part's first version: as many buckets as its rows need."""
        while self.manifest["buckets"][part] * self.bucket_rows < rows:
            self.manifest["buckets"][part] *= 2

    def _write(self, part: str, df: DataFrame, touched: set[int], version: str) -> None:
        """Rows of the touched buckets (with a column bucket) become their new version. A bucket's rows go to as many
        tasks as it may hold rows over BUCKET_ROWS, by a hash of the row."""
        path = f"{self.path}/{part}/v={version}"
        salts = max(1, -(-2 * self.manifest["rows"][part] // (self.manifest["buckets"][part] * self.bucket_rows)))
        spread = 4 if part == "baskets" else salts
        keys = [c for c in df.columns if c not in ("bucket", "n")]
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.manifest["buckets"][part] * spread if touched else 0)
        salt = F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(spread))
        df.repartition(tasks, "bucket", salt).write.mode("overwrite").partitionBy("bucket").parquet(path)
        fs, at = self._fs(path)
        there = {s.getPath().getName().partition("=")[2] for s in fs.listStatus(at) if s.getPath().getName().startswith("bucket=")}
        own = self.manifest["at"][part]
        for b in map(str, touched):
            own.pop(b, None)
        own.update(dict.fromkeys(there, version))

    def _grow(self) -> None:
        """Split the buckets of parts that have outgrown them."""
        for part, keys in (("baskets", ["basket"]), ("pairs", ["a", "b"]), ("items", ["item"])):
            rows = self._read(part).count()  # from the files' footers
            self.manifest["rows"][part] = rows
            if rows > 2 * self.manifest["buckets"][part] * self.bucket_rows:
                whole = self._read(part)
                self._size(part, rows)
                every = set(map(int, self.manifest["at"][part])) | set(range(self.manifest["buckets"][part]))
                self._write(part, whole.withColumn("bucket", self._bucket(part, *keys)), every, f"split-{uuid.uuid4().hex[:12]}")

    def _touched(self, df: DataFrame) -> set[int]:
        return {r.bucket for r in df.select("bucket").distinct().collect()}  # no more than there are buckets

    def apply(self, changes: DataFrame, basket: str, item: str, *, replace: bool = False) -> int:
        """Take in changed baskets and return the batch's number.

        The rows are items to add to their baskets or, with ``replace``, the whole new contents of each
        basket named in them (a row with a null item names a basket and adds nothing: alone, it empties
        it). Rows with a null basket are left out, repeated rows count once, and an empty table is a
        batch without effect. Baskets and items are compared as strings; other columns aren't read.
        """
        require(changes, basket, item)
        before = self.manifest
        self.manifest = copy.deepcopy(before)
        try:
            batch = self._apply(changes, basket, item, replace)
            self._grow()
            self._save(self.manifest)
        except BaseException:
            self.manifest = before
            raise
        return batch

    def _apply(self, changes: DataFrame, basket: str, item: str, replace: bool) -> int:
        batch = self.manifest["batch"] + 1
        # Folders are a writer's own, so a batch that is lost to another one spoils nothing.
        version = f"{batch}-{uuid.uuid4().hex[:12]}"
        self.manifest["log"] = {**self.manifest.get("log", {}), str(batch): version}
        log = f"{self.path}/log/v={version}"
        given = changes.select(F.col(q(basket)).cast("string").alias("basket"), F.col(q(item)).cast("string").alias("item")).where("basket IS NOT NULL").distinct()
        if self.manifest["at"]["baskets"]:
            given.withColumn("bucket", self._bucket("baskets", "basket")).write.mode("overwrite").parquet(f"{log}/given")
            given = self.spark.read.parquet(f"{log}/given")
            touched = self._touched(given)
            given = given.drop("bucket")
            old = self._read("baskets", touched).join(given.select("basket").distinct(), "basket", "left_semi").select("basket", "item", F.lit(1).alias("old"), F.lit(0).alias("new"))
            both = old.unionByName(given.where("item IS NOT NULL").select("basket", "item", F.lit(0).alias("old"), F.lit(1).alias("new")))
            both = both.groupBy("basket", "item").agg(F.max("old").alias("old"), F.max("new").alias("new"))
            new = F.col("new") if replace else F.lit(1)
            diff = both.select("basket", "item", (new - F.col("old")).alias("s"))
        else:
            touched = None
            diff = given.where("item IS NOT NULL").select("basket", "item", F.lit(1).alias("s"))
        diff.write.mode("overwrite").parquet(f"{log}/diff")
        diff = self.spark.read.parquet(f"{log}/diff")
        # A basket counts while it holds an item.
        was_is = diff.groupBy("basket").agg(F.max(F.col("s") <= 0).cast("int").alias("old"), F.max(F.col("s") >= 0).cast("int").alias("new"))
        self.manifest["baskets"] += was_is.agg(F.coalesce(F.sum(F.col("new") - F.col("old")), F.lit(0))).first()[0]

        if touched is None:
            self._size("baskets", diff.count())
        stay = diff.where("s >= 0").select("basket", "item").withColumn("bucket", self._bucket("baskets", "basket"))
        if touched is None:
            self._write("baskets", stay, set(), version)
        elif touched:
            others = self._read("baskets", touched).join(diff.select("basket").distinct(), "basket", "left_anti")
            self._write("baskets", others.withColumn("bucket", self._bucket("baskets", "basket")).unionByName(stay), touched, version)
        self._merge("pairs", pair_deltas(diff), ["a", "b"], log, version)
        self._merge("items", diff.groupBy("item").agg(F.sum("s").alias("d")).where("d <> 0"), ["item"], log, version)
        self.manifest["batch"] = batch
        return batch

    def _merge(self, part: str, delta: DataFrame, keys: list[str], log: str, version: str) -> None:
        """Add the signed deltas to the counts of the buckets that they touch; what falls to 0 goes."""
        delta.write.mode("overwrite").parquet(f"{log}/{part}")
        delta = self.spark.read.parquet(f"{log}/{part}")
        if not self.manifest["at"][part]:
            self._size(part, delta.count())
            self._write(part, delta.withColumnRenamed("d", "n").withColumn("bucket", self._bucket(part, *keys)), set(), version)
            return
        delta = delta.withColumn("bucket", self._bucket(part, *keys))
        if touched := self._touched(delta):
            old = self._read(part, touched).withColumn("bucket", self._bucket(part, *keys))
            new = old.unionByName(delta.withColumnRenamed("d", "n")).groupBy("bucket", *keys).agg(F.sum("n").alias("n")).where("n > 0")
            self._write(part, new, touched, version)

    def vacuum(self) -> None:
        """Delete what no reader of the current version needs: older versions of buckets, and logs but the last."""
        for part in PARTS:
            fs, folder = self._fs(f"{self.path}/{part}")
            live = {(str(v), str(b)) for b, v in self.manifest["at"][part].items()}
            for version in fs.listStatus(folder) if fs.exists(folder) else []:
                v = version.getPath().getName().partition("=")[2]
                for bucket in fs.listStatus(version.getPath()):
                    name = bucket.getPath().getName()
                    if name.startswith("bucket=") and (v, name.partition("=")[2]) not in live:
                        fs.delete(bucket.getPath(), True)
        fs, folder = self._fs(f"{self.path}/log")
        for log in fs.listStatus(folder) if fs.exists(folder) else []:
            if log.getPath().getName() != f"v={self.manifest.get('log', {}).get(str(self.manifest['batch']))}":
                fs.delete(log.getPath(), True)

    @property
    def total(self) -> int:
        """Baskets that hold an item."""
        return self.manifest["baskets"]

    def items(self) -> DataFrame:
        """``item``, ``n``."""
        return self._read("items")

    def pairs(self) -> DataFrame:
        """``a``, ``b``, ``n``."""
        return self._read("pairs")

    def _scored(self, pairs: DataFrame) -> DataFrame:
        i = self.items()
        both = pairs.join(i.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(i.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
        return both.select("a", "b", "n", "n_a", "n_b", (F.col("n").cast("double") * self.total / (F.col("n_a").cast("double") * F.col("n_b"))).alias("lift"))

    def scores(self, min_count: int = 1) -> DataFrame:
        """``a``, ``b``, ``n``, ``n_a``, ``n_b`` and ``lift``: the count against the one expected of independent
        items, n * total / (n_a * n_b)."""
        return self._scored(self.pairs().where(F.col("n") >= min_count))

    def affected(self, batch: int | None = None) -> DataFrame:
        """:meth:`scores` of the pairs whose own count or one of whose items' counts the batch (the last one)
        changed. The lift of every other pair changed by the ratio of the totals alone."""
        log = f"{self.path}/log/v={self.manifest['log'][str(batch or self.manifest['batch'])]}"
        touched = self.spark.read.parquet(f"{log}/items").select("item")
        p = self.pairs()
        hit = p.join(touched.withColumnRenamed("item", "a"), "a", "left_semi").unionByName(p.join(touched.withColumnRenamed("item", "b"), "b", "left_semi"))
        own = p.join(self.spark.read.parquet(f"{log}/pairs").select("a", "b"), ["a", "b"], "left_semi")
        return self._scored(hit.unionByName(own.select("a", "b", "n")).distinct())
