"""The registered queries: each applies one operator to all of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import exact_dedup, fim, fingerprints, katz, licenses, mixing, ngram_join, packing, pivot_index, prefix_trie, quality, sharding, toxicity
from .shared import settled, table

COLUMNS = {"op5": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]}


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark, sf_dir):
    return licenses.licenses(table(spark, sf_dir, "documents")).drop("spans")


def op2_vector_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def packed_conversations(spark, sf_dir):
    """All conversations as examples whose last assistant turn alone bears loss, packed like documents."""
    made = packing.examples(table(spark, sf_dir, "conversations"))
    return packing.pack(made, tokenizer(), prompt_chars=F.col("prompt_chars"))


def op3_toxicity_nnpu(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, *toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_histogram_shards(spark, sf_dir):
    return sharding.shards(table(spark, sf_dir, "documents"), 40)


def op5_katz_scores(spark, sf_dir):
    return katz.scored(table(spark, sf_dir, "documents")).select(*COLUMNS["op5"])


def op6_ngram_jaccard(spark, sf_dir):
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")


def op7_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_edit_fingerprints(spark, sf_dir):
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def near_fingerprints(spark, sf_dir):
    """Of the documents whose id is divisible by 100, all with a near fingerprint, by bands and verified."""
    return fingerprints.near_queries(settled(fingerprints.prints(table(spark, sf_dir, "documents")), "edit-prints"))


def op9_quality_bradley_terry(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("t")


def op11_fill_in_middle(spark, sf_dir):
    made = fim.transformed(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored("output", "form")).alias("restored_sha256"))


def op12_pivot_permutation(spark, sf_dir):
    return pivot_index.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), prefix_trie.EVERY, prefix_trie.MOST)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_vector_packing, op3_toxicity_nnpu, op4_histogram_shards, op5_katz_scores, op6_ngram_jaccard, op7_source_mix, op8_edit_fingerprints, op9_quality_bradley_terry, op10_exact_dedup, op11_fill_in_middle, op12_pivot_permutation, op13_prefix_trie, near_fingerprints, packed_conversations)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 by its bits: each byte is put to the register, then shifted out.
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''), lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b < 0 THEN xor(a >> 1, 3988292384 * (a & 1)) ELSE xor(a, b) END))"
ORACLE = {
    "op6_ngram_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
        u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n + b.n) AS total FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
        l AS (SELECT a, b FROM p WHERE 100 * common >= 85 * (total - common)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = doc_id), doc_id)) AS component_id FROM s""",
    "op10_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOW} AS low FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY low) AS keep_id, count(*) OVER (PARTITION BY low) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY low) AS kept, sha256(low) AS text_sha256 FROM t""",
    "op11_fill_in_middle": f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        d AS (SELECT doc_id, text, length(text) AS n, {', '.join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM t),
        r AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
              CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
        p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM r)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256 FROM p""",
    "op12_pivot_permutation": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id)) AS component_id FROM embeddings)
        SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM c""",
    "op13_prefix_trie": f"""
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
        k AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY i) AS l, {_CRC.format("CAST(c AS VARCHAR)")} % 6 AS h FROM t GROUP BY c),
        g AS (SELECT k.c, list_concat(coalesce(o.l, [])[1:k.h], k.l[k.h + 1:]) AS l FROM k LEFT JOIN k o ON o.c = k.c - k.c % 100),
        m AS (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM g),
        n AS (SELECT d, l[1:d] AS p, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(l) = d), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
        kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
        w AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n_convs - 1) * length(n.p[n.d].x) ELSE 0 END AS saves FROM n LEFT JOIN kids ON kids.d = n.d AND kids.p = n.p),
        u AS (SELECT p, d, n_children, saves, unnest(range(d + 1)) AS e FROM w),
        below AS (SELECT e AS d, p[1:e] AS p, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saves) AS BIGINT) AS saved_tokens FROM u GROUP BY 1, 2)
        SELECT w.conv_id, w.d AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
        FROM w JOIN below ON below.d = w.d AND below.p = w.p LEFT JOIN n up ON w.d > 0 AND up.d = w.d - 1 AND up.p = w.p[1:w.d - 1]""",
}
