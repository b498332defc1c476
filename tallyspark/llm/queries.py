"""The registered queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import chat, exactdedup, fingerprints, hardnegatives, minhash, packing, pii, sentencepieces, setjoin, tokenout, toxicity, urlfilter, vectorcodes
from tallyspark.llm.common import table, written


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    return sentencepieces.round_trips(sentencepieces.encode(table(spark, sf_dir, "documents"), model), model)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenout.write_and_check(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2, special=True)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.sql("SELECT -1L AS conv_id, posexplode(array('user', 'assistant')) AS (turn, role), '</s>[INST] ok [/INST]' AS text")
    return chat.read_back(written(chat.format_turns(rows.unionByName(hard)), "chat"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


#: Verdict, host and path of the rules that the URL query applies.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The list of blocked URLs is drawn from the pages: those on hosts with one of these labels.
LISTED_HOSTS = "(^|[.])(adult|free|spam)-[a-z]+[.]"


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(urlfilter.host_of(F.col("url")).rlike(LISTED_HOSTS))
    return urlfilter.judge(pages, listed, RULES)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.classify(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.report(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector stands under the label after its own; every hundredth is an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, relabel=label)


def op13_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.similar_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_fingerprints": op3_fingerprints,
    "op4_pii": op4_pii,
    "op5_minhash": op5_minhash,
    "op6_url_filter": op6_url_filter,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_ids": op8_token_ids,
    "op9_chat": op9_chat,
    "op10_toxicity": op10_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_set_join": op13_set_join,
}



def _similar(words: int, percent: int) -> str:
    """Components of documents whose sets of ``words`` words in a row are similar."""
    return rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {words - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {words - 1}) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {percent} * (nx.n + ny.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.seen FROM r JOIN e ON e.x = r.doc_id)
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(seen) AS component_id
        FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""


def _assigned(n: int, books: str) -> str:
    """Parts with their nearest entry of a codebook."""
    return f"""a{n} AS (SELECT vec_id, label, p, x, arg_min(j, struct_pack(d := d, j := j)) AS j, min(d) AS d FROM (
            SELECT v.vec_id, v.label, v.p, v.x, b.j, list_sum(list_transform(list_zip(v.x, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM cut v JOIN {books} b USING (p)) GROUP BY vec_id, label, p, x)"""


def _refitted(n: int, books: str) -> str:
    """Entries as floored means of the parts assigned to them; unused ones stay."""
    mean = "list_transform(range(1, len(any_value(x)) + 1), lambda i: CAST(floor(list_sum(list_transform(list(x), lambda y: y[i]))::DOUBLE / count(*)) AS BIGINT))"
    return f"b{n} AS (SELECT p, j, coalesce(m.e, o.e) AS e FROM {books} o LEFT JOIN (SELECT p, j, {mean} AS e FROM a{n} GROUP BY p, j) m USING (p, j))"


ORACLE: dict[str, str] = {
    "op11_vector_codes": f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cut AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM kept, range(16) r(p)),
        b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, x AS e FROM cut QUALIFY j < 64),
        {_assigned(1, "b0")}, {_refitted(1, "b0")}, {_assigned(2, "b1")}, {_refitted(2, "b1")}, {_assigned(3, "b2")},
        coded AS (SELECT vec_id, label, string_agg(format('{{:02x}}', j), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a3 GROUP BY vec_id, label)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, j)) FROM b2) AS codebooks_sha256 FROM coded""",
    "op12_hard_negatives": """
        WITH kept AS MATERIALIZED (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS MATERIALIZED (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM kept a, kept r WHERE a.id % 100 = 0 AND a.id <> r.id),
        positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
        FROM positives JOIN scored s USING (anchor_id) WHERE NOT same AND 100 * s.score BETWEEN 80 * positive_score AND 100 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY rank <= 5""",
    "op6_url_filter": r"""
        WITH u AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
        c AS (
            SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www[.]', ''), ':(80|443)\z', '')
                || regexp_replace(regexp_replace(path, '[.]html?\z', ''), '(/index)?/*\z', '') END AS canonical FROM u),
        listed AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '(^|[.])(adult|free|spam)-[a-z]+[.]')),
        rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        best AS (
            SELECT page_id, max_by(struct_pack(rule := h || p, verdict := verdict), length(h || p)) AS r FROM c, rules
            WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT page_id, host, path, r.rule AS rule,
               coalesce(r.verdict, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
               listed.canonical IS NOT NULL AS listed
        FROM c LEFT JOIN best USING (page_id) LEFT JOIN listed USING (canonical)""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op5_minhash": _similar(5, 75).replace("AS component_id", "AS component_id, r.doc_id = min(seen) AS kept"),
    "op13_set_join": _similar(4, 85),
    "op9_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        f AS (
            SELECT *, length(t) + len(regexp_extract_all(t, '<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>|<\\*\|turn\|>|<\\*\|end\|>'))
                + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 17 ELSE 18 + length(role) END AS size FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
               CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(t, '' ORDER BY turn, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(3 + sum(size) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id""",
}
