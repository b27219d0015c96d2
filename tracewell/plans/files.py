"""Queries of file versions, policy, edits and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ids import actor_descriptor, content_id, digest, sorted_map_json, withheld_descriptor
from ..functions.policy import Policy
from ..operators import graph, versions
from .base import big, query

POLICY = Policy(("src1*", "*7"), 4000)
DENIED = "(regexp_full_match(source, 'src1.*') OR regexp_full_match(source, '.*7'))"


@query(f"""WITH seen AS (SELECT source AS file_path, sha256(text) AS cid0, min(doc_id) AS first_seq, any_value(strlen(text)) AS content_bytes, {DENIED.replace("source", "any_value(source)")} AS denied FROM documents GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN denied THEN 'Denied' WHEN content_bytes > 4000 THEN 'TooLarge' END AS because FROM seen)
SELECT file_path, CAST(row_number() OVER w AS INT) AS file_version, cid0 AS cid, lag(cid0) OVER w AS replaced, CASE WHEN because IS NULL THEN 'stored' ELSE 'withheld' END AS content_state,
because AS withheld_because, content_bytes, first_seq FROM s WINDOW w AS (PARTITION BY file_path ORDER BY first_seq)""")
def file_versions(t):
    """Flagship: documents as observations of files -> versions, what each replaced, and whether its content may be stored."""
    return versions.file_versions(t("documents"), POLICY)


@query("""WITH o AS (SELECT source, doc_id, sha256(text) AS cid, lag(sha256(text)) OVER (PARTITION BY source ORDER BY doc_id) AS replaced FROM documents)
SELECT source, doc_id, cid, replaced, row_number() OVER (PARTITION BY source, cid ORDER BY doc_id) = 1 AS created FROM o WHERE replaced IS DISTINCT FROM cid""")
def supersessions(t):
    """Every change of what is current at a path; a revert creates nothing and still replaces."""
    seen = t("documents").select("source", "doc_id", digest("text").alias("cid"))
    return versions.supersessions(seen, [], "source", "cid", "doc_id")


@query("SELECT source, max(doc_id) AS doc_id, arg_max(sha256(text), doc_id) AS cid FROM documents GROUP BY 1")
def latest_content(t):
    """The latest content of each path."""
    return t("documents").groupBy("source").agg(F.max("doc_id").alias("doc_id"), F.max_by(digest("text"), "doc_id").alias("cid"))


@query("SELECT source, count(DISTINCT text) AS n_versions, count(*) AS n_seen FROM documents GROUP BY 1")
def versions_per_path(t):
    """Versions of each path."""
    seen = t("documents").select("source", "doc_id", digest("text").alias("cid"))
    return versions.version_chain(seen, [], "source", "cid", "doc_id").groupBy("source").agg(F.count("*").alias("n_versions"), F.sum("n_seen").alias("n_seen"))


@query(f"SELECT doc_id, CASE WHEN {DENIED} THEN 'Denied' WHEN strlen(text) > 4000 THEN 'TooLarge' ELSE 'Store' END AS disposition FROM documents")
def dispositions(t):
    """Store, Denied or TooLarge: globs on the path before the ceiling of size."""
    return t("documents").select("doc_id", POLICY.decide(F.col("source"), F.octet_length("text")).alias("disposition"))


@query(f"""WITH d AS (SELECT source, text, CASE WHEN {DENIED} THEN 'Denied' WHEN strlen(text) > 4000 THEN 'TooLarge' ELSE 'Store' END AS disposition, strlen(text) AS n FROM documents)
SELECT source, CAST(sum(n) FILTER (disposition = 'Store') AS BIGINT) AS bytes_stored, CAST(sum(n) FILTER (disposition = 'Denied') AS BIGINT) AS bytes_denied,
CAST(sum(n) FILTER (disposition = 'TooLarge') AS BIGINT) AS bytes_too_large FROM (SELECT DISTINCT source, text, disposition, n FROM d) GROUP BY 1""")
def byte_totals(t):
    """Bytes by disposition of distinct versions; a bucket without any is absent, not zero."""
    d = t("documents").select("source", digest("text").alias("cid"), big(F.octet_length("text")).alias("n")).distinct()
    d = d.withColumn("disposition", POLICY.decide(F.col("source"), F.col("n")))
    return d.groupBy("source").agg(*[F.sum(F.when(F.col("disposition") == k, F.col("n"))).alias(a) for k, a in (("Store", "bytes_stored"), ("Denied", "bytes_denied"), ("TooLarge", "bytes_too_large"))])


@query("""SELECT page_id, regexp_full_match(url, 'https://.*/en/.*') AS https_en, regexp_full_match(url, 'http.://.*') AS one_more, regexp_full_match(url, '.*[?]utm_source=feed') AS feed FROM pages""")
def glob_matches(t):
    """Globs over whole strings: * crosses separators, ? is one character."""
    g = lambda *x: X.glob_match("url", list(x))
    return t("pages").select("page_id", g("https://*/en/*").alias("https_en"), g("http?://*").alias("one_more"), F.col("url").rlike(X.glob_regex("*?utm_source=feed")).alias("feed"))


@query("SELECT page_id, CASE WHEN regexp_full_match(url, 'https://www.*') THEN 1 WHEN regexp_full_match(url, '.*example.org.*') THEN 2 WHEN regexp_full_match(url, 'http://.*') THEN 3 END AS block FROM pages")
def provider_blocks(t):
    """The first provider block that serves a call; null where none does."""
    from ..operators.pairing import first_match

    return first_match(t("pages"), "block", [(1, "https://www*"), (2, "*example.org*"), (3, "http://*")], F.col("url")).select("page_id", "block")


@query("""WITH q AS (SELECT source, list(DISTINCT lang) AS langs, list(DISTINCT 'src' || CAST(doc_id % 20 AS VARCHAR) ORDER BY 'src' || CAST(doc_id % 20 AS VARCHAR)) AS touched FROM documents GROUP BY 1)
SELECT source, len(touched) AS n_touched, len(list_filter(touched, lambda p: regexp_full_match(p, 'src1.*') OR regexp_full_match(p, '.*7'))) > 0 AS withheld,
list_filter(touched, lambda p: regexp_full_match(p, 'src1.*') OR regexp_full_match(p, '.*7'))[1] AS withheld_for FROM q""")
def quoted_paths(t):
    """A payload that quotes a denied path is withheld, and for which."""
    q = t("documents").groupBy("source").agg(F.array_sort(F.collect_set(F.concat(F.lit("src"), F.col("doc_id") % 20))).alias("touched"))
    denied = F.filter("touched", lambda p: POLICY.denies(p))
    return q.select("source", big(F.size("touched")).alias("n_touched"), (F.size(denied) > 0).alias("withheld"), F.try_element_at(denied, F.lit(1)).alias("withheld_for"))


@query("""SELECT doc_id, CASE WHEN contains(text, 'the') THEN regexp_replace(text, 'the', 'THE') END AS first_edit, CASE WHEN contains(text, 'the') THEN replace(text, 'the', 'THE') END AS all_edit FROM documents""")
def literal_edits(t):
    """A literal edit of the first or of all occurrences; null where it doesn't apply."""
    edit = lambda every: X.literal_edit(F.col("text"), F.lit("the"), F.lit("THE"), F.lit(every))
    return t("documents").select("doc_id", edit(False).alias("first_edit"), edit(True).alias("all_edit"))


@query("""WITH d AS (SELECT doc_id, text, CAST((length(text) - length(replace(text, 'th', ''))) / 2 AS BIGINT) AS n FROM documents)
SELECT doc_id, CASE WHEN n = 1 THEN replace(text, 'th', 'TH') END AS once, CASE WHEN n >= 1 THEN sha256(replace(text, 'th', 'TH')) END AS every FROM d""")
def strict_edits(t):
    """An edit of a virtual file must match once, or all matches must be asked for."""
    edit = lambda every: X.strict_edit(F.col("text"), F.lit("th"), F.lit("TH"), F.lit(every))
    return t("documents").select("doc_id", edit(False).alias("once"), digest(edit(True)).alias("every"))


@query("""WITH d AS (SELECT doc_id, text, right(text, 1) = chr(10) AS ended, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT *, CASE WHEN text = '' THEN [] WHEN ended THEN parts[:len(parts) - 1] ELSE parts END AS raw FROM d),
b AS (SELECT *, len(raw) AS n, list_transform(raw, lambda x, i: CASE WHEN (i < len(raw) OR ended) AND right(x, 1) = chr(13) THEN left(x, -1) ELSE x END) AS bare FROM l),
e AS (SELECT *, len(list_filter(bare, lambda x: x = coalesce(bare[1], ''))) AS same, len(list_filter(raw, lambda x, i: right(x, 1) = chr(13) AND (i < len(raw) OR ended))) AS feeds FROM b),
r AS (SELECT *, CASE WHEN same > 1 THEN 'Ambiguous' WHEN same = 0 THEN 'NotFound' WHEN n = 1 AND NOT ended THEN 'UnterminatedAtEof' WHEN feeds > 0 THEN 'TerminatorsNotEstablished' END AS refusal FROM e)
SELECT doc_id, refusal, CASE WHEN refusal IS NULL AND text IS NOT NULL THEN sha256('replaced' || chr(10) || substr(text, length(raw[1]) + 2)) END AS cid FROM r""")
def line_edits(t):
    """The first line of each document replaced as a run of lines, or why that can't be known."""
    first = F.regexp_replace(F.coalesce(F.get(X.lines_of("text"), F.lit(0)), F.lit("")), "\r?\n$", "")
    edit = t("documents").select("doc_id", X.line_edit(F.col("text"), F.array(first), F.array(F.lit("replaced"))).alias("e"))
    return edit.select("doc_id", F.col("e.refusal").alias("refusal"), digest("e.text").alias("cid"))


@query("SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS BIGINT) AS n_full, sha256(text || CASE WHEN text = '' OR right(text, 1) = chr(10) THEN '' ELSE chr(10) END) AS cid FROM documents")
def line_splits(t):
    """Lines keep their terminators, and are joined with a final one."""
    rows = X.lines_of("text")
    bare = F.transform(rows, lambda x: F.regexp_replace(x, "\n$", ""))
    return t("documents").select("doc_id", big(F.size(F.filter(bare, lambda x: x != ""))).alias("n_full"), digest(X.as_lines(bare)).alias("cid"))


@query("""SELECT page_id, ['a/' || CAST(page_id AS VARCHAR), 'b.txt', 'c'] AS paths FROM pages""")
def patch_paths(t):
    """The paths a patch names, in order and once."""
    patch = F.concat(F.lit("*** Begin Patch\n*** Add File: a/"), "page_id", F.lit("\n+x\n*** Update File: b.txt \n*** Move to: c\n-*** Add File: no\n*** Delete File: b.txt\n*** End Patch"))
    return t("pages").select("page_id", X.patch_paths(patch).alias("paths"))


@query("""SELECT source, lang, sha256('{"kind":"' || lang || '","name":"' || source || '"}') AS actor, min(doc_id) AS first_seq FROM documents GROUP BY 1, 2""")
def actors(t):
    """Actors by kind and name, once, through a serialised descriptor."""
    d = t("documents").groupBy("source", "lang").agg(F.min("doc_id").alias("first_seq"))
    return d.withColumn("actor", digest(actor_descriptor("lang", "source")))


@query("""SELECT doc_id, sha256('{"content-cid":"' || sha256(text) || '","withheld":true}') AS cid FROM documents""")
def withheld_ids(t):
    """Identity of withheld content: over the true id, without the path."""
    return t("documents").select("doc_id", digest(withheld_descriptor(digest("text"))).alias("cid"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'deleted:' || source WHEN doc_id % 3 = 1 THEN 'unknown:' || source ELSE sha256(text) END AS cid,
CASE WHEN doc_id % 3 = 0 THEN 'deleted' WHEN doc_id % 3 = 1 THEN 'unknown' WHEN strlen(text) > 2000 THEN 'withheld' ELSE 'stored' END AS content_state FROM documents""")
def content_states(t):
    """Deleted, unknown, withheld and stored content stay apart."""
    from ..functions.policy import content_key, content_state

    mode = F.when(F.col("doc_id") % 3 == 0, "Deleted").otherwise("Wrote")
    content = F.when(F.col("doc_id") % 3 == 2, F.col("text"))
    state = content_state(content, mode, Policy((), 2000).decide(F.col("source"), F.octet_length(content)))
    return t("documents").select("doc_id", content_key(F.col("source"), digest("text"), state).alias("cid"), state.alias("content_state"))


@query("""SELECT DISTINCT source, sha256(text) AS cid, sha256(lang || ':' || source) AS metadata_cid FROM documents""")
def registrations(t):
    """One registration for each content and description."""
    return t("documents").select("source", digest("text").alias("cid"), digest(F.concat("lang", F.lit(":"), "source")).alias("metadata_cid")).dropDuplicates()


@query("""WITH a AS (SELECT DISTINCT sha256(text) AS cid, lang FROM documents), c AS (SELECT DISTINCT source FROM documents),
n AS (SELECT count(DISTINCT cid) + count(*) + (SELECT count(*) FROM c) AS own FROM a)
SELECT own AS n_statements, own AS n_credentials, own AS n_subjects FROM n""")
def credentials(t):
    """Credentials, their subjects and the other statements are as many."""
    d = t("documents")
    s = graph.statements(d.select(digest("text").alias("cid"), F.col("lang").alias("metadata_cid")), d.select(F.col("source").alias("comp_id")).distinct())
    is_proof = F.col("type") == "CredentialRegistration"
    return s.agg(F.count_if(~is_proof).alias("n_statements"), F.count_if(is_proof).alias("n_credentials"), F.count_distinct(F.when(is_proof, F.col("subject"))).alias("n_subjects"))


@query("""SELECT lang, count(*) AS n_assets, count(DISTINCT text) AS n_contents, list(DISTINCT source ORDER BY source) AS agents FROM documents GROUP BY 1""")
def asset_counts(t):
    """Assets by type, and the agents that made them."""
    return t("documents").groupBy("lang").agg(F.count("*").alias("n_assets"), F.count_distinct("text").alias("n_contents"), F.array_sort(F.collect_set("source")).alias("agents"))


@query(f"SELECT doc_id, source FROM documents WHERE {DENIED} OR strlen(text) > 4000")
def withheld_assets(t):
    """What was withheld."""
    return t("documents").filter(POLICY.decide(F.col("source"), F.octet_length("text")) != "Store").select("doc_id", "source")


@query("SELECT source, count(*) FILTER (contains(text, '@')) AS n_leaks, bool_or(contains(text, '@')) AS leaked FROM documents GROUP BY 1")
def leak_scan(t):
    """Which stores hold a needle."""
    hit = F.contains("text", F.lit("@"))
    return t("documents").groupBy("source").agg(F.count_if(hit).alias("n_leaks"), F.bool_or(hit).alias("leaked"))


@query("SELECT source, len(list_distinct(list(sha256(text)))) AS n_documents, count(*) AS n_retrieved FROM documents GROUP BY 1")
def retrieved_documents(t):
    """Documents of a retrieval, once each."""
    return t("documents").groupBy("source").agg(F.count_distinct(digest("text")).alias("n_documents"), F.count("*").alias("n_retrieved"))


@query("""SELECT doc_id, sha256(text) AS cid, replace(source, 'src', '/') AS path FROM documents d WHERE NOT EXISTS
(SELECT 1 FROM (VALUES ('/1'), ('/7')) b(base) WHERE replace(d.source, 'src', '/') = base OR starts_with(replace(d.source, 'src', '/'), base || '/'))""")
def prefix_deletion(t):
    """A deletion drops a path and everything below it, not its neighbours."""
    d = t("documents").select("doc_id", digest("text").alias("cid"), F.regexp_replace("source", "src", "/").alias("path"))
    gone = F.lit(False)
    for base in ("/1", "/7"):
        gone = gone | (F.col("path") == base) | F.startswith("path", F.lit(f"{base}/"))
    return d.filter(~gone)


@query("SELECT page_id, length(html) AS n_chars, url LIKE 'https%' AS is_safe, '/' || regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '/+', '/', 'g'), '/$', '') AS path FROM pages")
def normal_paths(t):
    """Virtual paths from their root."""
    path = X.normal_path(F.regexp_replace("url", "^https?://", "./"))
    return t("pages").select("page_id", big(F.length("html")).alias("n_chars"), F.startswith("url", F.lit("https")).alias("is_safe"), path.alias("path"))


@query(r"""SELECT page_id, array_to_string(list_transform(string_split(url, ''), lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z0-9-]$') THEN c ELSE '_' || printf('%06x', unicode(c)) END), '') AS safe FROM pages""")
def path_safe_ids(t):
    """Session ids as file names: an injective escape."""
    return t("pages").select("page_id", X.path_safe("url").alias("safe"))


@query("SELECT doc_id, encode(text) IS NOT NULL AS valid, sha256(text) AS cid FROM documents")
def utf8_round_trip(t):
    """Content is valid UTF-8 and survives base64."""
    back = F.unbase64(F.base64(F.encode("text", "utf-8")))
    return t("documents").select("doc_id", F.is_valid_utf8("text").alias("valid"), F.sha2(back, 256).alias("cid"))


@query("""SELECT l_orderkey, sha256('{"flag":"' || l_returnflag || '","line":"' || CAST(l_linenumber AS VARCHAR) || '","status":"' || l_linestatus || '"}') AS id FROM lineitem""")
def canonical_maps(t):
    """Identity of a flat map: JSON with sorted keys, whatever the order it was built in."""
    m = F.create_map(F.lit("status"), "l_linestatus", F.lit("flag"), "l_returnflag", F.lit("line"), F.col("l_linenumber").cast("string"))
    return t("lineitem").select("l_orderkey", digest(sorted_map_json(m)).alias("id"))


@query()
def content_ids(t):
    """Interchange ids (CIDv1, BLAKE3) of benchmark items: no SQL has BLAKE3; golden vectors test it."""
    return t("benchmark").select("item_id", content_id(F.encode("text", "utf-8")).alias("cid"))


@query()
def replayed_edits(t):
    """Edits of documents replayed in order on held content: a fold, held against a plain one in the tests."""
    d = t("documents")
    rows = d.select(
        F.col("source").alias("session_id"), F.col("doc_id").alias("seq"), F.col("lang").alias("path"), F.lit("Wrote").alias("mode"),
        F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("content"), F.when(F.col("doc_id") % 3 != 0, F.lit("th")).alias("old"), F.lit("TH").alias("new"),
        F.lit(True).alias("replace_all"), (F.col("doc_id") % 3 == 2).alias("line_oriented"), F.lit(None).cast("string").alias("replay_from"),
    )
    return versions.replay(rows).withColumn("content", digest("content"))
