"""Duplicates of files: equal content, near-equal fingerprints, and which file is kept."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacat.storage import components, discard, partitions, stored


def part_matches(a: Column, b: Column, threshold: float = 0.9) -> Column:
    """Two hex parts of one length with few enough different characters."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    t = Fraction(str(threshold))
    return (F.length(a) == F.length(b)) & (same * t.denominator >= F.length(a) * t.numerator)


#: Keys at which more pairs of fingerprints than the square of this would meet are cut up further.
HOT_KEY = 1000
#: Rows of a hot key are dealt to so many tasks.
SALTS = 32
#: Buckets of an index of fingerprints.
BUCKETS = 64


def _cut(rows: DataFrame) -> DataFrame:
    """Each row's free places in d + 1 groups; a row for each group with the group's characters in its key."""
    groups = F.transform(F.sequence(F.lit(0), F.col("d")), lambda k: F.slice("free", F.floor(F.size("free") * k / (F.col("d") + 1)).cast("int") + 1, (F.floor(F.size("free") * (k + 1) / (F.col("d") + 1)) - F.floor(F.size("free") * k / (F.col("d") + 1))).cast("int")))
    out = rows.select("*", F.posexplode(groups).alias("__k", "__g"))
    bits = F.array_join(F.transform("__g", lambda p: F.substring(F.col("text"), p, F.lit(1))), "")
    return out.withColumns({"key": F.concat_ws("|", "key", "__k", bits), "free": F.array_except("free", "__g")}).drop("__k", "__g")


def banded(fingerprints: DataFrame, fp: str = "fp", threshold: float = 0.9) -> DataFrame:
    """(fp, text, d, free, key) of distinct fingerprints: parts that match within d different characters share a key.

    Of a part's characters at most d differ, so of d + 1 groups of places one is equal. free: the places that the key leaves open. Null and empty
    fingerprints and empty parts have no row.
    """
    t = Fraction(str(threshold))
    rows = fingerprints.where(F.col(fp).isNotNull() & (F.col(fp) != "")).select(F.col(fp).alias("fp")).distinct()
    rows = rows.select("fp", F.size(F.split("fp", ":")).alias("n"), F.posexplode(F.split("fp", ":")).alias("part", "text"))
    d = F.floor(F.length("text") * (t.denominator - t.numerator) / t.denominator).cast("int")
    rows = rows.where(F.length("text") > 0).select("fp", "text", d.alias("d"), F.sequence(F.lit(1), F.length("text")).alias("free"), F.concat_ws(":", "n", "part", F.length("text")).alias("key"))
    return _cut(rows)


def near_links(left: DataFrame, right: DataFrame, threshold: float = 0.9, hot: int = HOT_KEY) -> DataFrame:
    """(left_fp, right_fp) of banded() fingerprints with a matching part, equal ones too; each link once.

    A key that many fingerprints of both sides share is cut up again by its free places: those that share it differ in at most d of them. So no key
    grows with the table, unless at most d places are left, and then all that share it match.
    """
    match = lambda a, b: a.select(F.col("fp").alias("left_fp"), F.col("text").alias("left"), "key").join(b.select(F.col("fp").alias("right_fp"), F.col("text").alias("right"), "key"), "key").where(part_matches(F.col("left"), F.col("right"), threshold)).select("left_fp", "right_fp")
    found, same = [], left is right
    while True:
        left = stored(left, "bands")
        right = left if same else stored(right, "bands")
        n = lambda df, c: df.where(F.size("free") > F.col("d")).groupBy("key").agg(F.count("*").alias(c))
        both = n(left, "l").withColumn("r", F.col("l")) if same else n(left, "l").join(n(right, "r"), "key")
        many = stored(both.where(F.col("l") * F.col("r") > hot * hot).select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "hot-bands")
        salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
        if many.isEmpty():
            found.append(match(left, right))
            return reduce(DataFrame.union, found).distinct()
        cool = lambda df: salted(df).join(many, ["key", "salt"], "left_anti")
        found.append(match(cool(left), cool(right)))
        cut = lambda df: _cut(salted(df).join(many, ["key", "salt"], "left_semi").drop("salt")).select("fp", "text", "d", "free", "key")
        left, right = cut(left), cut(right)


def near_duplicate_join(left: DataFrame, right: DataFrame, fp: str = "perceptual_hash", threshold: float = 0.9) -> DataFrame:
    """(left_id, right_id) of fingerprints with a matching part; both have (id, fp). Parts are separated by colons and numbers of parts must agree.

    All pairs of files: of copies there are as many as the square of their number. near_duplicate_classes() has a row for each file instead.
    """
    rows = banded(left, fp, threshold)
    links = stored(near_links(rows, rows if right is left else banded(right, fp, threshold), threshold), "fingerprint-links")
    several = lambda df: df.groupBy("id").agg((F.count_distinct(fp) > 1).alias("many"))
    ids = lambda df, side: df.select("id", fp).distinct().join(several(df), "id").select(F.col(fp).alias(f"{side}_fp"), F.col("id").alias(f"{side}_id"), F.col("many").alias(f"{side}_many"))
    one, two = stored(ids(left, "left"), "left-ids"), stored(ids(right, "right"), "right-ids")
    # A pair can only come twice if one of its ids has several fingerprints: no other pairs are compared with each other.
    met = lambda a, b: links.join(a, "left_fp").join(b, "right_fp").where("left_id <> right_id").select("left_id", "right_id")
    if one.where("left_many").isEmpty() and two.where("right_many").isEmpty():
        return met(one, two)
    again = met(one.where("left_many"), two).unionByName(met(one.where("not left_many"), two.where("right_many"))).distinct()
    return met(one.where("not left_many"), two.where("not right_many")).unionByName(again)


def near_duplicate_classes(files: DataFrame, fp: str = "perceptual_hash", threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Near duplicates without all pairs of copies: (membership, links).

    membership (id, class_id, copies, links): a file's class is the smallest id of its fingerprint, with how many files share it and how many other
    classes it links to; a file without a fingerprint is its own class. links (left_class, right_class): matching classes, each once, left the smaller.
    """
    known = files.select("id", F.when(F.col(fp) != "", F.col(fp)).alias("fp"))
    classes = stored(known.where("fp is not null").groupBy("fp").agg(F.min("id").alias("class_id"), F.count("*").alias("copies")), "classes")
    rows = banded(classes, "fp", threshold)
    links = near_links(rows, rows, threshold).where("left_fp <> right_fp")
    name = lambda side: classes.select(F.col("fp").alias(f"{side}_fp"), F.col("class_id").alias(f"{side}_class"))
    links = stored(links.join(name("left"), "left_fp").join(name("right"), "right_fp").select("left_class", "right_class"), "class-links")
    degree = links.groupBy(F.col("left_class").alias("class_id")).agg(F.count("*").alias("links"))
    member = known.join(classes, "fp", "left").join(degree, "class_id", "left")
    member = member.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
    return member, links.where("left_class < right_class")


def write_fingerprints(files: DataFrame, path: str, fp: str = "perceptual_hash", threshold: float = 0.9) -> None:
    """Add the fingerprints of files (id, fp) to the index under path: their keys, in folders by bucket and sorted, so that a few new files read few of them."""
    least = files.where(F.col(fp).isNotNull() & (F.col(fp) != "")).groupBy(F.col(fp).alias("fp")).agg(F.min("id").alias("id"))
    rows = banded(least, "fp", threshold).join(least, "fp").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "key").write.mode("append").partitionBy("bucket").parquet(path)


def probe_fingerprints(files: DataFrame, path: str, fp: str = "perceptual_hash", threshold: float = 0.9) -> DataFrame:
    """(fp, known_id): the smallest id in the index whose fingerprint matches, for each fingerprint of files that has one. Only keys of files are read from the index."""
    spark = files.sparkSession
    own = stored(banded(files, fp, threshold), "probe-bands")
    index = spark.read.schema("fp string, text string, d int, free array<int>, key string, id long, bucket int").parquet(path)
    asked = own.select("key", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct()
    near = stored(index.join(asked, ["bucket", "key"], "left_semi"), "index-bands")
    links = near_links(own, near.select("fp", "text", "d", "free", "key"), threshold)
    ids = near.groupBy(F.col("fp").alias("right_fp")).agg(F.min("id").alias("known_id"))
    return links.join(ids, "right_fp").groupBy(F.col("left_fp").alias("fp")).agg(F.min("known_id").alias("known_id"))


#: Components of at most so many links are settled whole by one scan; of larger ones, so many files at a time.
MOST_LINKS, MOST_FILES = 1_000_000, 20_000


def _drops(links: DataFrame) -> DataFrame:
    """(id) of the files that go, of links (root, early, ep, late, lp) of whole components or of their first files: one scan of
    the links in order of the later file, as a file's fate only hangs on earlier ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gone = None, set()
        for b in batches:
            out = []
            for root, early, late in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if root != now:
                    now, gone = root, set()
                if early not in gone and late not in gone:
                    gone.add(late)
                    out.append(late)
            yield pa.RecordBatch.from_arrays([pa.array(out, b.column(2).type)], ["id"])

    kind = links.schema["late"].dataType.simpleString()
    rows = links.repartition(partitions(links.sparkSession), "root").sortWithinPartitions("root", "lp", "ep")
    return rows.select("root", "early", "late").mapInArrow(run, f"id {kind}")


def elect_keepers(files: DataFrame, edges: DataFrame, order: list[str], most_links: int = MOST_LINKS, most_files: int = MOST_FILES) -> DataFrame:
    """(id, keeper, duplicate_of): a file is kept if no earlier kept file matches it, and else is a duplicate of the smallest such id.

    files (id, order columns); edges (left_id, right_id), either way. Files that no chain of matches joins are settled side by
    side. A component of over most_links links takes rounds: its first most_files files are settled by one scan, what they match goes.
    """
    place = files.select("id", F.struct(*dict.fromkeys([*order, "id"])).alias("place"))
    e = edges.where("left_id <> right_id").join(place.select(F.col("id").alias("left_id"), F.col("place").alias("lp")), "left_id").join(place.select(F.col("id").alias("right_id"), F.col("place").alias("rp")), "right_id")
    one, two = (F.struct(F.col(f"{s}_id").alias("id"), F.col(p).alias("place")) for s, p in (("left", "lp"), ("right", "rp")))
    first = F.col("lp") < F.col("rp")
    e = e.select(F.when(first, one).otherwise(two).alias("e"), F.when(first, two).otherwise(one).alias("l"))
    e = stored(e.select(F.col("e.id").alias("early"), F.col("e.place").alias("ep"), F.col("l.id").alias("late"), F.col("l.place").alias("lp")).distinct(), "edges")
    roots = components(e.select(F.col("early").alias("a"), F.col("late").alias("b")))
    e = stored(e.join(roots.withColumnRenamed("node", "late"), "late").select("root", "early", "ep", "late", "lp"), "edges")
    giant = F.broadcast(e.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > most_links).select("root"))  # at most a root for most_links links
    gone = [stored(_drops(e.join(giant, "root", "left_anti")), "gone")]
    left = stored(e.join(giant, "root", "left_semi"), "edges")
    while not left.isEmpty():
        nodes = left.select("root", F.col("early").alias("id"), F.col("ep").alias("place")).union(left.select("root", "late", "lp")).distinct()
        head = nodes.withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy("place"))).where(F.col("r") <= most_files)
        head = stored(head.select("id"), "head")
        lost = stored(_drops(left.join(head.withColumnRenamed("id", "late"), "late", "left_semi").select(left.columns)), "gone")
        kept = head.join(lost, "id", "left_anti")
        next_to = stored(left.join(kept.withColumnRenamed("id", "early"), "early", "left_semi").select(F.col("late").alias("id")).distinct(), "gone")
        gone += [lost, next_to]
        done = stored(head.union(next_to).distinct(), "done")
        rest = left.join(done.withColumnRenamed("id", "late"), "late", "left_anti").join(done.withColumnRenamed("id", "early"), "early", "left_anti")
        rest = stored(rest.select(left.columns), "edges")
        discard(left, head, done)
        left = rest
    out = reduce(DataFrame.union, gone).distinct().withColumn("__gone", F.lit(True))
    state = stored(files.select("id").join(out, "id", "left").select("id", F.col("__gone").isNull().alias("keeper")), "state")
    of = e.join(state.where("keeper").select(F.col("id").alias("early")), "early", "left_semi").groupBy(F.col("late").alias("id")).agg(F.min("early").alias("__of"))
    return state.join(of, "id", "left").select("id", "keeper", F.when(~F.col("keeper"), F.col("__of")).alias("duplicate_of"))


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def duplicates(files: DataFrame, order: list[str], threshold: float = 0.9, known: DataFrame | None = None, index: str | None = None) -> DataFrame:
    """(id, keeper, duplicate_of, score): equal content first (1.0), then near fingerprints among what is left (0.9). files (id, file_hash, perceptual_hash, order columns).

    known (id, file_hash, perceptual_hash): files already stored; they are kept whatever the new files are, so a new file that matches one is its
    duplicate (the smallest matching id, before any new file). index: where write_fingerprints() put their fingerprints; without it they are cut into keys here.
    Files of one fingerprint meet the others through the first of them: they match alike, and match each other. A null hash or fingerprint matches nothing.
    """
    cols = list(dict.fromkeys([*order, "id"]))
    place = F.struct(*cols)

    def with_first(df: DataFrame, by: str, name: str) -> DataFrame:
        least = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.min_by("id", place).alias("__first"))
        return df.join(least, by, "left").withColumn(name, F.coalesce("__first", "id")).drop("__first")

    print_ = F.when(F.col("perceptual_hash") != "", F.col("perceptual_hash")).alias("perceptual_hash")
    exact = with_first(files.select(*cols, "file_hash", print_), "file_hash", "first")
    if known is not None:
        stored_hashes = known.where("file_hash is not null").groupBy("file_hash").agg(F.min("id").alias("__old"))
        exact = exact.join(stored_hashes, "file_hash", "left")
    else:
        exact = exact.withColumn("__old", F.lit(None).cast("long"))
    exact = stored(exact.drop("file_hash"), "exact")
    left = exact.where("id = first and __old is null")
    if left.where("perceptual_hash is not null").isEmpty():
        near = left.select(F.col("id").alias("first"), F.lit(True).alias("__k"), F.lit(None).cast(left.schema["id"].dataType).alias("__d"))
    else:
        near = _near(left.select(*cols, "perceptual_hash"), cols, order, threshold, known, index)
    # A copy of a file that is itself no keeper is compared like that file: it has the same fingerprint.
    of = exact.where("__old is null").select("id", "first").join(near, "first")
    own = F.col("id") == F.col("first")
    of = of.select("id", (own & F.col("__k")).alias("keeper"), F.when(own, F.col("__d")).when(F.col("__k"), F.col("first")).otherwise(F.col("__d")).alias("duplicate_of"), F.when(own & F.col("__k"), None).when(~own & F.col("__k"), 1.0).otherwise(0.9).alias("score"))
    return of.unionByName(exact.where("__old is not null").select("id", F.lit(False).alias("keeper"), F.col("__old").alias("duplicate_of"), F.lit(1.0).alias("score")))


def _near(left: DataFrame, cols: list[str], order: list[str], threshold: float, known: DataFrame | None, index: str | None) -> DataFrame:
    """(first, __k, __d): which of the files of different content stay, and whose duplicates the others are."""
    place = F.struct(*cols)
    left = stored(left, "contents")
    if known is not None or index:
        # Stored files are decided: what matches one goes before the others are elected.
        if index:
            hits = probe_fingerprints(left, index, "perceptual_hash", threshold)
        else:
            ids = known.where("perceptual_hash <> ''").groupBy(F.col("perceptual_hash").alias("right_fp")).agg(F.min("id").alias("known_id"))
            links = near_links(banded(left, "perceptual_hash", threshold), banded(known, "perceptual_hash", threshold), threshold)
            hits = links.join(ids, "right_fp").groupBy(F.col("left_fp").alias("fp")).agg(F.min("known_id").alias("known_id"))
        left = stored(left.join(hits.withColumnRenamed("fp", "perceptual_hash"), "perceptual_hash", "left"), "seeded")
    else:
        left = left.withColumn("known_id", F.lit(None).cast(left.schema["id"].dataType))
    seeded = left.where("known_id is not null").select(F.col("id").alias("first"), F.lit(False).alias("__k"), F.col("known_id").alias("__d"))
    left = left.where("known_id is null")
    least = left.where("perceptual_hash is not null").groupBy("perceptual_hash").agg(F.min_by("id", place).alias("__rep"))
    left = stored(left.join(least, "perceptual_hash", "left").select(*cols, "perceptual_hash", F.coalesce("__rep", "id").alias("rep")), "fingerprinted")
    reps = left.where("id = rep")
    edges = stored(near_duplicate_join(reps, reps, "perceptual_hash", threshold), "near-edges")
    elected = stored(elect_keepers(reps.select(*cols), edges.where("left_id < right_id"), order), "near")
    # A later file of a fingerprint goes: to its first if that is kept, else to the smallest kept one before it that the first matches.
    kept = reps.join(elected.where("keeper").select("id"), "id", "left_semi").select(F.col("id").alias("left_id"), place.alias("__before"))
    others = left.where("id <> rep").select("id", F.col("rep").alias("right_id"), place.alias("__at"))
    of = others.join(edges.join(kept, "left_id"), "right_id").where("__before < __at").groupBy("id").agg(F.min("left_id").alias("__of"))
    state = elected.select(F.col("id").alias("rep"), F.col("keeper").alias("__rk"), F.col("duplicate_of").alias("__rd"))
    own = F.col("id") == F.col("rep")
    near = left.select("id", "rep").join(state, "rep").join(of, "id", "left")
    near = near.select(F.col("id").alias("first"), (own & F.col("__rk")).alias("__k"), F.when(own, F.col("__rd")).when(F.col("__rk"), F.col("rep")).otherwise(F.col("__of")).alias("__d"))
    return near.unionByName(seeded)
