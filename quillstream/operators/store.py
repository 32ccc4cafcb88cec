"""The item store: batches of collected rows are persisted as versions of a bucketed table.

    items/v=<n>/bucket=<b>      items by hash of their canonical address
    prints/v=<n>/bucket=<b>     (source_id, fingerprint) -> item, by hash of the pair
    revisions/v=<n>, outcomes/v=<n>
    manifest/v=<n>              where each bucket's newest rows stand; complete only with its _SUCCESS file

A batch reads and rewrites only the buckets that it touches.  All its files come before its manifest, and a reader
starts from the newest complete manifest, so a batch is seen whole or not at all; a repeated attempt overwrites what
an interrupted one has left.  One writer at a time.

Which item a row hits is found from keys alone.  The rows are then dealt by their item's bucket, and a part of the
buckets after the other meets its stored items, so that whole texts are shuffled for one part at a time.  Such
intermediate tables stand in work/ as long as the batch lasts.

A batch has seq (its order), run_id (ascending with seq), run_at, source_id, source_name, canonical_url,
original_url, fingerprint, parent_fingerprint and the columns of CONTENT, TAXONOMY, VERIFICATION and CLASSES; those
that it lacks are null.  Rows persist in order of seq:

* A row hits the stored or just inserted item with its address, else the one of its source with its fingerprint,
  else it is inserted.  Its item's id is a hash of the address, which never changes; nor does the fingerprint.
* In a run, the first row of a source that hits an item counts; later ones are in-batch duplicates and do nothing,
  also where the run comes in several batches.
* The item's own source changes the content, with a revision of the fields that differ, and always its classes; the
  taxonomy if the row has a primary_type; verification and review unless they were set by hand; the parent if
  the row names one that the source has inserted before.
* Another source's hit only notes where else the item was seen, from when to when.
* A row without seq, run_id, source_id or canonical_url is invalid and leaves no trace but its outcome; a null
  fingerprint equals no other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import upsert as P

CONTENT = {"title": "string", "summary": "string", "published_at": "timestamp", "extra": "string"}
CLASSES = {"category": "string", "classification_score": "double", "classification_reason": "string", "provider": "string"}
TAXONOMY = {
    "primary_type": "string", "topic_tags": "array<string>", "industry_tags": "array<string>", "case_completeness": "string", "taxonomy_version": "string",
    "organizer": "string", "application_name": "string", "application_target": "string", "deadline_at": "timestamp", "application_method": "string", "application_url": "string",
}
VERIFICATION = {"verification_status": "string", "discovery_url": "string", "official_url": "string", "origin_publisher": "string"}
REVIEW = {"review_status": "string"}
KEYS = {"source_id": "long", "source_name": "string", "canonical_url": "string", "original_url": "string", "fingerprint": "string", "parent_fingerprint": "string"}
BATCH = {"seq": "long", "run_id": "long", "run_at": "timestamp"} | KEYS | CONTENT | CLASSES | TAXONOMY | VERIFICATION | REVIEW
SEEN = "struct<source_id:long,source_name:string,first_seen_at:timestamp,last_seen_at:timestamp,last_run:long>"
ITEM = (
    {"item_id": "string", "source_id": "long", "canonical_url": "string", "original_url": "string", "fingerprint": "string"} | CONTENT | CLASSES | TAXONOMY | VERIFICATION | REVIEW
    | {"manual_category": "string", "verification_manually_set": "boolean", "review_manually_set": "boolean", "admission_accepted": "boolean", "parent_item_id": "string",
       "discovered_at": "timestamp", "last_seen_at": "timestamp", "last_run": "long", "discoveries": f"array<{SEEN}>"}
)
PRINT = {"source_id": "long", "fingerprint": "string", "item_id": "string", "canonical_url": "string"}
REVISION = {"item_id": "string", "run_id": "long", "changed_at": "timestamp", "old_data": "string", "new_data": "string"}
OUTCOME = {"seq": "long", "run_id": "long", "source_id": "long", "item_id": "string", "outcome": "string", "category": "string"}
#: On which of an item's columns a set of the batch's columns depends: (columns, the row has them if, but not if)
GROUPS = [(CONTENT | CLASSES, None, None), (TAXONOMY, "primary_type", None), (VERIFICATION, "verification_status", "verification_manually_set"), (REVIEW, "review_status", "review_manually_set")]


#: Bytes of files that one part of the buckets takes, and how many parts there are at most.
PART_BYTES, PARTS = 64 << 20, 16


def _schema(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in columns.items())


def item_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 32)


def _short(fingerprint: Column) -> Column:
    """Of a long one its hash, which no short one equals, so that matches carry no whole titles."""
    return F.when(F.length(fingerprint) > 64, F.concat(F.lit("#"), F.sha2(fingerprint, 256))).otherwise(fingerprint)


class ItemStore:
    """A store in the folder `root`, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # versions ------------------------------------------------------------------------------------------------------

    def _names(self, folder: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}/{n}/_SUCCESS")))

    def version(self) -> int:
        """The newest complete version, 0 for an empty store."""
        return max(self._names("manifest"), default=0)

    def _manifest(self, version: int) -> dict[tuple[str, int], int]:
        """(kind, bucket) -> version that has its rows; two rows a bucket, and one for each stream."""
        if not version:
            return {}
        rows = self.spark.read.schema("kind string, bucket long, at long").json(f"{self.root}/manifest/v={version:09d}").collect()
        return {(r.kind, r.bucket): r.at for r in rows}

    def _read(self, kind: str, columns: dict[str, str], manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """The rows of some buckets, all by default; only their files are listed."""
        paths = [f"{self.root}/{kind}/v={at:09d}/bucket={b}" for (k, b), at in manifest.items() if k == kind and (buckets is None or b in buckets)]
        if not paths:
            return self.spark.createDataFrame([], _schema(columns))
        return self.spark.read.schema(_schema(columns)).parquet(*paths)

    def items(self, version: int | None = None) -> DataFrame:
        return self._read("items", ITEM, self._manifest(self.version() if version is None else version))

    def _upto(self, kind: str, columns: dict[str, str]) -> DataFrame:
        paths = [f"{self.root}/{kind}/v={v:09d}" for v in range(1, self.version() + 1)]
        return self.spark.read.schema(_schema(columns)).parquet(*paths) if paths else self.spark.createDataFrame([], _schema(columns))

    def revisions(self) -> DataFrame:
        return self._upto("revisions", REVISION)

    def outcomes(self) -> DataFrame:
        """What became of each row of every batch."""
        return self._upto("outcomes", OUTCOME)

    # writing -------------------------------------------------------------------------------------------------------

    def _bucket(self, *keys: Column) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _touched(self, *columns: Column, of: DataFrame) -> list[int]:
        """The distinct numbers in these columns, at most as many as there are buckets."""
        one = reduce(DataFrame.unionAll, [of.select(c.alias("b")) for c in columns])
        return [r.b for r in one.filter("b IS NOT NULL").distinct().collect()]

    def _write(self, rows: DataFrame, kind: str, columns: dict[str, str], version: int, bucket: Column | None = None, mode: str = "overwrite") -> None:
        out = rows.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()], *([bucket.alias("bucket")] if bucket is not None else []))
        out = out.hint("rebalance", F.col("bucket")) if bucket is not None else out
        P.write_files(out, f"{self.root}/{kind}/v={version:09d}", mode, "bucket" if bucket is not None else None)

    def persist(self, batch: DataFrame, stream: tuple[str, int] | None = None) -> DataFrame:
        """Persists a batch as the next version; returns the outcomes of its rows.

        stream: a stream's name and the number of its batch; one that the store has already is not applied again."""
        last = self.version()
        manifest = self._manifest(last)
        if stream and manifest.get((f"stream:{stream[0]}", -1), -1) >= stream[1]:
            return self.spark.createDataFrame([], _schema(OUTCOME))
        version, work = last + 1, P.Work(self.spark, f"{self.root}/work")
        work.drop()  # what an interrupted attempt has left
        try:
            touched, touched_marks = self._persist(batch, manifest, version, work)
        finally:
            work.drop()
        manifest |= {("items", b): version for b in touched} | {("prints", b): version for b in touched_marks}
        if stream:
            manifest[f"stream:{stream[0]}", -1] = stream[1]
        self._publish(manifest, version)
        return self.spark.read.schema(_schema(OUTCOME)).parquet(f"{self.root}/outcomes/v={version:09d}")

    def _persist(self, batch: DataFrame, manifest: dict, version: int, work: P.Work) -> tuple[list[int], list[int]]:
        """Writes all of a version but its manifest; the buckets of items and of prints that have new files."""
        begun = set()

        def put(rows: DataFrame, kind: str, columns: dict[str, str], bucket: Column | None = None) -> None:
            self._write(rows, kind, columns, version, bucket, "append" if kind in begun else "overwrite")
            begun.add(kind)

        given = {c.lower() for c in batch.columns}
        rows = work.save(batch.select(*[(F.col(c) if c.lower() in given else F.lit(None)).cast(t).alias(c) for c, t in BATCH.items()]), "rows")
        valid = F.col("canonical_url").isNotNull() & F.col("source_id").isNotNull() & F.col("seq").isNotNull() & F.col("run_id").isNotNull()
        hits = work.save(self._hits(rows.filter(valid), manifest, work))
        hits = work.save(self._counting(hits, self._read("items", ITEM, manifest, self._touched(F.col("bucket"), of=hits))))
        none = lambda of, name: of.select("seq", "run_id", "source_id", *[x.alias(c) for c, x in (("item_id", F.col("item_id") if "item_id" in of.columns else F.lit(None)), ("outcome", F.lit(name)), ("category", F.lit(None)))])
        rest = work.save(none(rows.filter(~valid), "invalid").unionByName(none(hits.filter(~F.col("counts")), "in_batch_duplicate")).select(*[F.col(c).cast(t) for c, t in OUTCOME.items()]))

        hits = hits.filter("counts")
        touched = self._touched(F.col("bucket"), of=hits)
        parts = self._parts(manifest, touched, work)
        counting = rows.join(hits.select("seq", "item_id", "item_url", "owner", "inserted", "parent_id", (F.col("bucket") % parts).alias("part")), "seq")
        counting = work.save(counting, "counting", by="part")
        work.drop("rows")

        new = counting.filter("inserted").select(*PRINT).filter("fingerprint IS NOT NULL")
        marks = self._bucket(F.col("source_id"), F.col("fingerprint"))
        touched_marks = self._touched(marks, of=new)
        put(self._read("prints", PRINT, manifest, touched_marks).unionByName(new), "prints", PRINT, marks)
        for part in sorted({b % parts for b in touched}):
            old = self._read("items", ITEM, manifest, [b for b in touched if b % parts == part])
            applied = work.save(self._applied(self.spark.read.schema(counting.drop("part").schema).parquet(f"{work.root}/counting/part={part}"), old), "applied")
            work.drop(f"counting/part={part}")
            put(self._after(applied, old), "items", ITEM, self._bucket(F.col("canonical_url")))
            put(self._revised(applied), "revisions", REVISION)
            put(self._outcomes(applied), "outcomes", OUTCOME)
            work.drop("applied")
        if not touched:
            put(self.spark.createDataFrame([], _schema(REVISION)), "revisions", REVISION)
        put(rest, "outcomes", OUTCOME)
        return touched, touched_marks

    def _parts(self, manifest: dict, touched: list[int], work: P.Work) -> int:
        """In how many parts the touched buckets are taken: by the size of the batch and of their stored items."""
        stored = P.Work(self.spark, f"{self.root}/items")
        size = work.bytes("rows") + sum(stored.bytes(f"v={manifest['items', b]:09d}/bucket={b}") for b in touched if ("items", b) in manifest)
        return max(1, min(PARTS, self.buckets, -(-size // PART_BYTES)))

    def replace(self, items: DataFrame) -> None:
        """A version whose items are these, such as a manual mutation's result; addresses and fingerprints stay as they were."""
        version, manifest = self.version() + 1, self._manifest(self.version())
        self._write(P.checkpointed(items), "items", ITEM, version, self._bucket(F.col("canonical_url")))
        for kind, columns in (("revisions", REVISION), ("outcomes", OUTCOME)):
            self._write(self.spark.createDataFrame([], _schema(columns)), kind, columns, version)
        self._publish(manifest | {k: version for k in manifest if k[0] == "items"}, version)

    def _publish(self, manifest: dict, version: int) -> None:
        listed = self.spark.createDataFrame([(k, b, at) for (k, b), at in manifest.items()], "kind string, bucket long, at long")
        listed.coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/v={version:09d}")

    def _hits(self, rows: DataFrame, manifest: dict, work: P.Work) -> DataFrame:
        """Of rows, their keys with item_id, item_url and its bucket, the item's own source, parent_id, and whether the row inserts it."""
        sought = F.when(F.length("parent_fingerprint") == 64, F.col("parent_fingerprint"))
        marks = [F.when(x.isNotNull(), self._bucket(F.col("source_id"), x)) for x in (F.col("fingerprint"), sought)]
        prints = self._read("prints", PRINT, manifest, self._touched(*marks, of=rows)).withColumn("fingerprint", _short(F.col("fingerprint")))
        stored = self._read("items", ITEM, manifest, self._touched(self._bucket(F.col("canonical_url")), of=rows)).select("canonical_url", F.col("item_id").alias("u_id"), F.col("source_id").alias("u_source"))
        rows = rows.select("seq", "run_id", "source_id", "canonical_url", _short(F.col("fingerprint")).alias("fingerprint"), sought.alias("sought"))
        by_mark = prints.select("source_id", "fingerprint", F.col("item_id").alias("f_id"), F.col("canonical_url").alias("f_url"))
        met = rows.join(stored, "canonical_url", "left").join(by_mark, ["source_id", "fingerprint"], "left")
        met = work.save(met)
        fresh = met.filter("u_id IS NULL AND f_id IS NULL")
        into = work.save(P.first_wins(fresh.select(F.col("seq").alias("rowno"), "source_id", "canonical_url", "fingerprint"), work.save))
        anchor = fresh.join(into.filter("rowno = into").select(F.col("rowno").alias("seq")), "seq", "left_semi").select(F.col("seq").alias("a_seq"), F.col("canonical_url").alias("a_url"), F.col("source_id").alias("a_source"), F.col("fingerprint").alias("a_print"))
        # a row that no stored address knows: an address of this batch before it, then a stored fingerprint, then one of this batch
        by_url = anchor.select(F.col("a_url").alias("canonical_url"), F.col("a_seq").alias("n_seq"), F.col("a_source").alias("n_source"))
        by_order = into.join(anchor, F.col("into") == F.col("a_seq")).select(F.col("rowno").alias("seq"), "a_url", "a_source")
        near = F.col("n_seq") <= F.col("seq")
        case = lambda stored, url, mark, other: F.when(F.col("u_id").isNotNull(), stored).when(near, url).when(F.col("f_id").isNotNull(), mark).otherwise(other)
        url = case(F.col("canonical_url"), F.col("canonical_url"), F.col("f_url"), F.col("a_url"))
        out = met.join(by_url, "canonical_url", "left").join(by_order, "seq", "left").select(
            "seq", "run_id", "source_id", "sought", case(F.col("u_id"), item_id(F.col("canonical_url")), F.col("f_id"), item_id(F.col("a_url"))).alias("item_id"), url.alias("item_url"),
            case(F.col("u_source"), F.col("n_source"), F.col("source_id"), F.col("a_source")).alias("owner"), (F.col("u_id").isNull() & F.coalesce(F.col("n_seq") == F.col("seq"), F.lit(False))).alias("inserted"),
        )
        # a parent is one that the source had before this row
        parents = prints.select(F.col("source_id").alias("p_source"), F.col("fingerprint").alias("p_print"), F.col("item_id").alias("parent_id"), F.lit(-1).cast("long").alias("p_seq")).unionByName(
            anchor.select(F.col("a_source").alias("p_source"), F.col("a_print").alias("p_print"), item_id(F.col("a_url")).alias("parent_id"), F.col("a_seq").alias("p_seq"))
        )
        found = out.select("seq", F.col("source_id").alias("p_source"), F.col("sought").alias("p_print")).filter("p_print IS NOT NULL").join(parents, ["p_source", "p_print"]).filter("p_seq < seq").select("seq", "parent_id")
        return out.drop("sought").join(found, "seq", "left").withColumn("bucket", self._bucket(F.col("item_url")))

    def _counting(self, hits: DataFrame, old: DataFrame) -> DataFrame:
        """hits and whether a row counts: of each item, run and source the first does, unless the run has been there before."""
        firsts = hits.groupBy("item_id", "run_id", "source_id").agg(F.min("seq").alias("seq"))
        been = old.select("item_id", F.explode(F.concat(F.array(F.struct("source_id", "last_run")), F.transform("discoveries", lambda x: F.struct(x["source_id"].alias("source_id"), x["last_run"].alias("last_run"))))).alias("s")).select("item_id", "s.*")
        fresh = firsts.join(been, ["item_id", "source_id"], "left").filter("last_run IS NULL OR last_run < run_id").select("seq", F.lit(True).alias("counts"))
        return hits.join(fresh, "seq", "left").withColumn("counts", F.coalesce("counts", F.lit(False)))

    def _applied(self, rows: DataFrame, old: DataFrame) -> DataFrame:
        """The rows that count with what they find: the content before them, and the category that the item has after them."""
        columns = rows.columns
        own = F.col("source_id") == F.col("owner")
        before = old.select("item_id", F.struct(*CONTENT).alias("stored"), F.col("manual_category"), F.col("category").alias("stored_category"))
        rows = rows.join(before, "item_id", "left")
        now = F.struct(*CONTENT)
        order = Window.partitionBy("item_id").orderBy("seq")
        upto = order.rowsBetween(Window.unboundedPreceding, -1)
        prior = F.coalesce(F.last(F.when(own, now), ignorenulls=True).over(upto), F.col("stored"))
        category = F.coalesce("manual_category", F.last(F.when(own, F.struct("category")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))["category"], "stored_category")
        return rows.select(*columns, own.alias("own"), F.when(own & ~F.col("inserted"), prior).alias("prior"), category.alias("effective"))

    def _after(self, applied: DataFrame, old: DataFrame) -> DataFrame:
        """The items that the rows leave: changed, new, and those of old that no row hits as they were."""
        own, pick = F.col("own"), lambda value, when: F.max_by(value, F.when(when, F.col("seq")))
        aggs = [pick(F.struct(*columns), own if has is None else own & F.col(has).isNotNull()).alias(f"g{i}") for i, (columns, has, _) in enumerate(GROUPS)]
        aggs += [pick(F.col("parent_id"), own & F.col("parent_id").isNotNull()).alias("parent"), F.max_by("run_at", "seq").alias("seen"), F.max(F.when(own, F.col("run_id"))).alias("run")]
        aggs += [F.max(F.when(F.col("inserted"), F.struct("source_id", "canonical_url", "original_url", "fingerprint", "run_at"))).alias("born"), F.first("item_url").alias("url")]
        by = applied.groupBy("item_id").agg(*aggs)
        # sightings by other sources, those already noted first
        noted = old.join(by.select("item_id"), "item_id", "left_semi").select("item_id", F.explode("discoveries").alias("d")).select("item_id", "d.*", F.lit(-1).cast("long").alias("seq"))
        new = applied.filter(~own).select("item_id", "source_id", "source_name", F.col("run_at").alias("first_seen_at"), F.col("run_at").alias("last_seen_at"), F.col("run_id").alias("last_run"), "seq")
        seen = noted.unionByName(new).groupBy("item_id", "source_id").agg(
            F.max_by("source_name", "seq").alias("source_name"), F.min_by("first_seen_at", "seq").alias("first_seen_at"), F.max_by("last_seen_at", "seq").alias("last_seen_at"), F.max("last_run").alias("last_run")
        )
        lists = seen.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("source_id", "source_name", "first_seen_at", "last_seen_at", "last_run"))).alias("found"))
        was = old.select(*[F.col(c).alias(f"o_{c}") if c != "item_id" else F.col(c) for c in ITEM])
        rows = by.join(was, "item_id", "full").join(lists, "item_id", "left")
        made, missed = F.col("o_source_id").isNull(), F.col("url").isNull()
        out = {"canonical_url": F.coalesce("o_canonical_url", "born.canonical_url", "url")}
        for c in ("source_id", "original_url", "fingerprint"):
            out[c] = F.when(made, F.col(f"born.{c}")).otherwise(F.col(f"o_{c}"))
        for i, (columns, _, held) in enumerate(GROUPS):
            stays = F.col(f"g{i}").isNull() | (F.coalesce(F.col(f"o_{held}"), F.lit(False)) if held else F.lit(False))
            out |= {c: F.when(stays, F.col(f"o_{c}")).otherwise(F.col(f"g{i}.{c}")) for c in columns}
        out |= {
            "manual_category": F.col("o_manual_category"), "verification_manually_set": F.coalesce("o_verification_manually_set", F.lit(False)), "review_manually_set": F.coalesce("o_review_manually_set", F.lit(False)),
            "admission_accepted": F.lit(True), "parent_item_id": F.coalesce("parent", "o_parent_item_id"), "discovered_at": F.coalesce("o_discovered_at", "born.run_at"), "last_seen_at": F.col("seen"),
            "last_run": F.coalesce("run", "o_last_run"), "discoveries": F.coalesce("found", F.array().cast(f"array<{SEEN}>")),
        }
        return rows.select("item_id", *[F.when(missed, F.col(f"o_{c}")).otherwise(out[c].cast(t)).alias(c) for c, t in ITEM.items() if c != "item_id"])

    def _revised(self, applied: DataFrame) -> DataFrame:
        """old_data and new_data as JSON of the fields that changed, times in UTC."""
        as_text = lambda c, x: F.date_format(F.to_utc_timestamp(x, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'") if CONTENT[c] == "timestamp" else x
        differs = {c: ~F.col(f"prior.{c}").eqNullSafe(F.col(c)) for c in CONTENT}
        rows = applied.filter(F.col("prior").isNotNull()).filter(reduce(Column.__or__, differs.values()))
        pairs = lambda get: F.to_json(F.map_from_entries(F.array_compact(F.array(*[F.when(differs[c], F.struct(F.lit(c).alias("key"), as_text(c, get(c)).alias("value"))) for c in CONTENT]))), {"ignoreNullFields": "false"})
        return rows.select("item_id", "run_id", F.col("run_at").alias("changed_at"), pairs(lambda c: F.col(f"prior.{c}")).alias("old_data"), pairs(F.col).alias("new_data"))

    def _outcomes(self, applied: DataFrame) -> DataFrame:
        changes = P.revision({c: F.col(f"prior.{c}") for c in CONTENT}, {c: F.col(c) for c in CONTENT})
        outcome = P.outcome(F.when(F.col("inserted"), None).otherwise(F.col("owner")), F.col("source_id"), F.when(F.col("own"), changes), F.lit(False))
        return applied.select("seq", "run_id", "source_id", "item_id", outcome.alias("outcome"), F.col("effective").alias("category"))


def insert_if_absent(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The stored rows, and of the others the first of each key that is not among them."""
    fresh = rows.join(stored.select(key), key, "left_anti")
    columns = [c for c in rows.columns if c != key]
    first = fresh.groupBy(key).agg(F.min(F.struct(*columns)).alias("r")).select(key, "r.*")
    return stored.unionByName(first.select(*stored.columns))

