"""The provenance graph: statements, edges, collections, coverage, and the questions asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import collection_id


def edges(computations: DataFrame, *keys: str) -> DataFrame:
    """(keys…, comp_id, direction, pos, cid) of computations with arrays ``inputs`` and ``outputs``."""
    sides = F.array(F.struct(F.lit("input").alias("direction"), F.col("inputs").alias("cids")), F.struct(F.lit("output").alias("direction"), F.col("outputs").alias("cids")))
    return computations.select(*keys, "comp_id", F.inline(sides)).select(*keys, "comp_id", "direction", F.posexplode("cids").alias("pos", "cid"))


def orphans(produced: DataFrame, consumed: DataFrame, key: str = "cid") -> DataFrame:
    """What is produced and never consumed."""
    return produced.join(consumed.select(key).distinct(), key, "left_anti")


def seal(members: DataFrame, keys: list[str], member: str, seq: str, withheld: str | None = None) -> DataFrame:
    """Distinct members in first-seen order with zero-padded ordinals, at least four digits wide."""
    first = members.groupBy(*keys, member).agg(F.min(seq).alias("first_seq"), F.max(withheld or F.lit(False)).alias("withheld"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("first_seq")) - 1
    width = F.greatest(F.lit(4), F.length((F.count("*").over(Window.partitionBy(*keys)) - 1).cast("string")))
    return first.withColumn("n", n).withColumn("ordinal", F.lpad(F.col("n").cast("string"), width, "0")).drop("n")


def collections(sealed: DataFrame, keys: list[str], member: str) -> DataFrame:
    """One row a collection: its id over the sorted members, their number, how many are withheld."""
    pair = F.struct(F.col("ordinal"), F.col(member).alias("cid"))
    return sealed.groupBy(*keys).agg(collection_id(F.collect_list(pair)).alias("cid"), F.count("*").alias("n_members"), F.count_if("withheld").alias("n_withheld"))


def coverage(counted: DataFrame, keys: list[str], counter: str = "counter") -> DataFrame:
    """The counter map of each key, and its JSON with sorted names."""
    n = counted.groupBy(*keys, counter).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(counter), F.col("n"))))
    return n.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias("coverage"))


def first_in(df: DataFrame, keys: list[str], order: str, where: Column | None = None) -> DataFrame:
    """The first row of each key; only the key's least row is kept while aggregating, no sort of the group."""
    df = df.filter(where) if where is not None else df
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(row, order).alias("row")).select("row.*")


def merge(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Union in which our rows win."""
    return ours.unionByName(theirs.join(ours.select(key), key, "left_anti").select(*ours.columns))


def diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, differs) of two summaries."""
    b, a = (df.select(key, F.col(value).alias(n)) for df, n in ((before, "before"), (after, "after")))
    return b.join(a, key, "full").withColumn("differs", ~F.col("before").eqNullSafe(F.col("after")))


def grade(seen: DataFrame, expected: DataFrame) -> DataFrame:
    """Expectations (counter, expectation) against counters: YES where seen, else MISSING if required, else absent."""
    return expected.join(seen.select("counter", "n"), "counter", "left").select(
        "counter", "expectation", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.when(F.coalesce("n", F.lit(0)) > 0, "YES").when(F.col("expectation") == "required", "MISSING").otherwise("absent").alias("grade"),
    )


def statements(assets: DataFrame, computations: DataFrame) -> DataFrame:
    """One data and one metadata statement for each content, a computation each, and a credential for every statement."""
    data = assets.select("cid").distinct().select(F.concat(F.lit("data:"), "cid").alias("id"), F.lit("DataRegistration").alias("type"), F.col("cid").alias("subject"))
    meta = assets.select("cid", "metadata_cid").distinct().select(F.concat(F.lit("meta:"), "cid", F.lit(":"), "metadata_cid").alias("id"), F.lit("MetadataRegistration").alias("type"), F.col("cid").alias("subject"))
    comp = computations.select(F.concat(F.lit("comp:"), F.col("comp_id").cast("string")).alias("id"), F.lit("ComputationRegistration").alias("type"), F.col("comp_id").cast("string").alias("subject"))
    own = data.unionByName(meta).unionByName(comp)
    proofs = own.select(F.concat(F.lit("cred:"), "id").alias("id"), F.lit("CredentialRegistration").alias("type"), F.col("id").alias("subject"))
    return own.unionByName(proofs)
