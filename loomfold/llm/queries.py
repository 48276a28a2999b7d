"""The registered queries of the corpus operators, with SQL where SQL can say the same."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomfold.lineage import keep
from loomfold.llm import bytebpe, crosstoken, fertility, htmltext, logbilinear, merkle, mixing, neardup, secrets, topk, toxicity, urlrules, warc
from loomfold.llm.common import bounded_batches, held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of every fiftieth vector."""
    return topk.search(_table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


def op2_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, fertility measures and verdict of every document."""
    return fertility.judge(_table(spark, sf_dir, "documents")).drop("lang")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes decoded from them."""
    bounded_batches(spark, 2048)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.col("ids")
    return bytebpe.encode(docs, path, keep=["doc_id"]).select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(bytebpe.decode(ids, path), 256).alias("decoded_sha256"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the secrets in every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, keep=["doc_id"])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return urlrules.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).drop("matched_rules")


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document, by shingles of two words."""
    found = neardup.grouped(_table(spark, sf_dir, "documents").select("doc_id", "text"), neardup.NearRules(words=2))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; every fifth id, by checksum, is kept from training."""
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    rules = toxicity.ToxicRules()
    scored = toxicity.score(docs, toxicity.fit(docs, labels, rules), keep=["doc_id"], out="score", rules=rules)
    return scored.select("doc_id", held_out(F.col("doc_id"), rules.folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract(pages, keep=["page_id", "url"]).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op10_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document, by the model and by counts alone."""
    return logbilinear.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and payload digest of every page's record in an archive without copies."""
    found = warc.archived(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("original").cast("long").alias("refers_to"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verification of every document."""
    found = merkle.manifest(keep(merkle.document_leaves(_table(spark, sf_dir, "documents"))), "source", ["doc_id"])
    told = lambda c: F.lower(F.hex(c))
    proof = F.lower(F.array_join(F.transform("steps", lambda s: F.concat(F.hex(s["left"]), F.hex(s["right"]))), ""))
    found = found.withColumn("_folded", merkle.fold(F.col("tampered"), F.col("steps")))
    return found.select("doc_id", *[told(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(proof, 256).alias("proof_sha256"),
                        told(F.col("_folded")).alias("folded_root"), (F.col("_folded") == F.col("root")).alias("verified"))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over every document."""
    return crosstoken.align(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_tokeniser_fertility, op3_byte_bpe, op4_secret_scan, op5_source_mix, op6_url_rules, op7_lsh_forest, op8_toxicity, op9_main_text,
                                op10_log_bilinear, op11_warc_revisits, op12_merkle_manifest, op13_cross_tokenizer)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLE: dict[str, str] = {
    "op1_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_lsh_forest": r"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM t),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT doc_id, count(*) AS n, sum(CAST(hash(g) AS HUGEINT)) AS h FROM s GROUP BY doc_id),
        p AS (SELECT min(doc_id) AS doc_id, n, h FROM c GROUP BY n, h),
        q AS (SELECT s.* FROM s JOIN p USING (doc_id)),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM q a JOIN q b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
              UNION SELECT p.doc_id, c.doc_id FROM c JOIN p USING (n, h) WHERE p.doc_id <> c.doc_id),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
        SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, t.doc_id = m.component_id AS kept
        FROM t LEFT JOIN n USING (doc_id) JOIN m ON m.doc_id = t.doc_id""",
    "op5_source_mix": r"""
        WITH d AS (SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
                          CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix-1'), 1, 15) AS BIGINT) AS k FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 3 * source_size AS cap FROM s),
        o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS pos FROM w),
        p AS (SELECT *, (sum(source_size) OVER ()) - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                     sum(w) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others FROM o),
        f AS (SELECT *, min(CASE WHEN rest * w <= cap * others THEN pos END) OVER () AS first FROM p),
        t AS (SELECT source, source_size, CASE WHEN pos >= first THEN CAST(w * max(CASE WHEN pos = first THEN rest END) OVER () AS DOUBLE)
                     / max(CASE WHEN pos = first THEN others END) OVER () ELSE CAST(cap AS DOUBLE) END AS target FROM f),
        c AS (SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM c)
        SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN size * (epochs + CASE WHEN start + size / 2 < target - epochs * source_size THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
        FROM e""",
    # base 32 takes the digest's bits by fives
    "op11_warc_revisits": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
        b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', substr(h, i, 1)) - 3, 4)), '') AS bits FROM d)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, 5 * k + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * k + 2, 1) AS INT)
                   + 4 * CAST(substr(bits, 5 * k + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * k + 4, 1) AS INT) + CAST(substr(bits, 5 * k + 5, 1) AS INT) AS INT), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM b""",
    "op12_merkle_manifest": r"""
        WITH RECURSIVE f AS (SELECT doc_id, source, text,
                coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
                coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail, replace(text, chr(10), '') AS cut,
                list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
                    lambda c, x: list_reduce(list_prepend(xor(c, x), CAST(range(8) AS BIGINT[])), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))) AS crc FROM documents),
        leaves AS (SELECT doc_id, source, sha256(head || tail) AS leaf,
                CASE WHEN xor(crc, 4294967295) % 2 = 0 AND text IS NOT NULL THEN sha256(head || octet_length(encode(cut)) || ':' || cut) ELSE sha256(head || tail) END AS tampered FROM f),
        o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves),
        t(tree, level, l) AS (SELECT tree, 0, list(leaf ORDER BY pos) FROM o GROUP BY tree
            UNION ALL SELECT tree, level + 1, list_transform(range(0, (len(l) + 2) // 3), lambda i: sha256(array_to_string(l[3 * i + 1 : 3 * i + 3], ''))) FROM t WHERE len(l) > 1),
        s AS (SELECT tree, max(level) AS height, arg_max(l, level)[1] AS subroot FROM t GROUP BY tree),
        u(level, l) AS (SELECT 0, list(subroot ORDER BY tree) FROM s
            UNION ALL SELECT level + 1, list_transform(range(0, (len(l) + 2) // 3), lambda i: sha256(array_to_string(l[3 * i + 1 : 3 * i + 3], ''))) FROM u WHERE len(l) > 1),
        every AS (SELECT t.tree, t.level, t.l FROM t JOIN s USING (tree) WHERE len(t.l) > 1 UNION ALL SELECT s.tree, s.height + u.level, u.l FROM s CROSS JOIN u WHERE len(u.l) > 1),
        w AS (SELECT o.doc_id, o.pos, o.tree, e.level, e.l, CAST(CASE WHEN e.level < s.height THEN o.pos // CAST(pow(3, e.level) AS BIGINT) ELSE o.tree // CAST(pow(3, e.level - s.height) AS BIGINT) END AS BIGINT) AS here
              FROM o JOIN s USING (tree) JOIN every e ON e.tree = o.tree),
        steps AS (SELECT tree, pos, level, array_to_string(l[3 * (here // 3) + 1 : here], '') AS a, array_to_string(l[here + 2 : 3 * (here // 3) + 3], '') AS b FROM w),
        proof AS (SELECT tree, pos, string_agg(a || b, '' ORDER BY level) AS p FROM steps GROUP BY tree, pos),
        fold(tree, pos, level, state) AS (SELECT tree, pos, 0, tampered FROM o
            UNION ALL SELECT f.tree, f.pos, f.level + 1, sha256(x.a || f.state || x.b) FROM fold f JOIN steps x ON x.tree = f.tree AND x.pos = f.pos AND x.level = f.level),
        ended AS (SELECT tree, pos, arg_max(state, level) AS folded_root FROM fold GROUP BY tree, pos),
        r AS (SELECT arg_max(l, level)[1] AS root FROM u)
        SELECT o.doc_id, o.leaf, s.subroot, r.root, sha256(coalesce(p.p, '')) AS proof_sha256, e.folded_root, e.folded_root = r.root AS verified
        FROM o JOIN s USING (tree) CROSS JOIN r JOIN ended e ON e.tree = o.tree AND e.pos = o.pos LEFT JOIN proof p ON p.tree = o.tree AND p.pos = o.pos""",
}
