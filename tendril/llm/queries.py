"""The queries of this package: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, collocations, mixing, neighbours, pieces, pii, scoring, secrets, simhash, sketches, substrings, toxicity, urls


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(_documents(spark, sf_dir), b"a key that only the query uses")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op4_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_documents(spark, sf_dir))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_documents(spark, sf_dir)).drop("kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprint_edits(_documents(spark, sf_dir))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return secrets.scan(docs, secrets.train(docs))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_documents(spark, sf_dir), pieces.load())


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_documents(spark, sf_dir))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), urls.rule_table(spark))


QUERIES = {"op1_toxicity": op1_toxicity, "op2_pii": op2_pii, "op3_simhash": op3_simhash, "op4_scoring": op4_scoring, "op5_substrings": op5_substrings, "op6_mixing": op6_mixing, "op7_sketches": op7_sketches, "op8_secrets": op8_secrets, "op9_pieces": op9_pieces, "op10_neighbours": op10_neighbours, "op11_alignment": op11_alignment, "op12_collocations": op12_collocations, "op13_urls": op13_urls}
ORACLES: dict[str, str] = {
    "op5_substrings": r"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS l FROM documents),
        s AS (SELECT doc_id, l, unnest(range(1, len(l) - 48)) AS i FROM w WHERE len(l) >= 50),
        x AS (SELECT doc_id, i, md5(array_to_string(l[i:i + 49], ' ')) AS k FROM s),
        m AS (SELECT k, min(doc_id) AS lo FROM x GROUP BY k),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM x JOIN m USING (k) WHERE doc_id > lo),
        g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
          sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN l ELSE list_transform(list_filter(range(1, len(l) + 1), lambda q: NOT list_contains(ps, q)), lambda q: l[q]) END, ' '), '')) AS kept_sha256
        FROM w LEFT JOIN g USING (doc_id)""",
    "op10_neighbours": """
        WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(q.v, lambda x: x * x))) * sqrt(list_sum(list_transform(c.v, lambda x: x * x)))) AS score
              FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
        SELECT * FROM r WHERE rank <= 5""",
    "op12_collocations": r"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
        p AS (SELECT lang, unnest(string_split_regex(x, '[.,;:!?\n-\r]')) AS piece FROM t),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda s: s <> '') AS l FROM p),
        n AS (SELECT lang, CAST(sum(len(l)) AS BIGINT) AS n FROM w GROUP BY lang),
        k AS (SELECT unnest([1, 2, 3, 4]) AS k),
        s AS (SELECT lang, l, k, unnest(range(1, len(l) - k + 2)) AS i FROM w JOIN k ON len(l) >= k),
        g AS (SELECT lang, k, array_to_string(l[i:i + k - 1], ' ') AS phrase, l[i:i + k - 1] AS ws FROM s),
        f AS (SELECT lang, k, phrase, first(ws) AS ws, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
        c AS (SELECT lang, phrase, ws, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
        d AS (SELECT c.lang, c.phrase, a, cut, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score
              FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[cut + 1:], ' ')),
        e AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM d),
        z AS (SELECT lang, k, f, ws, unnest(range(2, k)) AS j FROM f WHERE k > 2),
        y AS (SELECT lang, f, j, ws, unnest(range(1, k - j + 2)) AS i FROM z),
        h AS (SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, max(f) AS longer FROM y GROUP BY 1, 2),
        q AS (SELECT e.lang, e.phrase, a, l, r, score, row_number() OVER (PARTITION BY e.lang ORDER BY score DESC, a DESC, e.phrase) AS rank FROM e LEFT JOIN h USING (lang, phrase) WHERE o = 1 AND NOT coalesce(100 * longer >= 80 * a, false))
        SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_urls": r"""
        WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS v(h, p, a)),
        u AS (SELECT DISTINCT host, path FROM p),
        b AS (SELECT host, path, arg_max(h || r.p, length(h || r.p)) AS rule, arg_max(a, length(h || r.p)) AS verdict FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY host, path)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (host, path)""",
}
