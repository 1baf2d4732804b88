"""The operators' queries over whole tables, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .bytecnn import held_out_quality
from .classlm import held_out_scores
from .collocations import collocations
from .decontam import decontaminate
from .langid import held_out_predictions
from .licenses import scan_licenses
from .mixing import shares
from .packing import pack
from .quality import quality_rules
from .search import search
from .setjoin import jaccard_classes
from .substring import dedup_substrings
from .urlfilter import LISTED_LABELS, filter_urls


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_predictions(_table(spark, sf_dir, "documents"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_scores(_table(spark, sf_dir, "documents"))


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op11_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(_table(spark, sf_dir, "documents")).drop("source")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_license_scan, op3_language_id, op4_class_lm, op5_byte_cnn, op6_best_fit_packing, op7_url_filter, op8_decontamination, op9_jaccard_join, op10_substring_dedup, op11_weighted_mix, op12_collocations, op13_ranked_search)}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WHITE = r"[\x20\x09-\x0D]+"
_ENDS, _BLANK = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"


def _words(text: str, lower: bool, pattern: str) -> str:
    text = f"coalesce({text}, '')"
    text = f"translate({text}, '{_UP}', '{_LOW}')" if lower else text
    return f"list_filter(regexp_split_to_array({text}, '{pattern}'), lambda x: x <> '')"


ORACLES = {
    "op7_url_filter": f"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN list_has_any(string_split(host, '.'), [{", ".join(f"'{x}'" for x in LISTED_LABELS)}]) THEN 'block'
    ELSE 'allow' END AS verdict
FROM r""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, {_words("text", True, _ALNUM)} AS w FROM documents),
b AS (SELECT item_id, {_words("text", True, _ALNUM)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS width, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
    FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, width, array_to_string(w[i:i + width - 1], ' ') AS g
    FROM d, (SELECT DISTINCT width FROM win) AS k, unnest(range(1, len(w) - width + 2)) AS t(i)),
hit AS (SELECT doc_id, i, width, item_id FROM dw JOIN win USING (width, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + width)) AS t(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op9_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text", True, _WHITE)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) AS r ON r.a = d.doc_id""",
    "op10_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_words("text", False, _WHITE)} AS w FROM documents),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS place FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
gone AS (SELECT DISTINCT doc_id, p FROM g, unnest(range(i, i + 20)) AS t(p) WHERE place > 1),
w AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
k AS (SELECT w.doc_id, count(*) AS n_words, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN word END, ' ' ORDER BY p) AS kept
    FROM w LEFT JOIN gone USING (doc_id, p) GROUP BY w.doc_id)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op12_collocations": f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_ENDS}')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '{_BLANK}'), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, w[i:i + k - 1] AS ws FROM p, unnest([1, 2, 3]) AS t(k), unnest(range(1, len(w) - k + 2)) AS u(i)),
f AS (SELECT lang, k, phrase, any_value(ws) AS ws, count(*) AS n FROM g GROUP BY 1, 2, 3),
tot AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE k > 1 AND n >= 10),
q AS (SELECT c.lang, c.phrase, c.k, c.n AS a, j, x.n AS l, y.n AS r, CAST(1000000::HUGEINT * c.n * c.n // (x.n::HUGEINT * y.n) AS BIGINT) AS score FROM c, unnest(range(1, c.k)) AS t(j)
    JOIN f AS x ON x.lang = c.lang AND x.k = j AND x.phrase = array_to_string(c.ws[1:j], ' ') JOIN f AS y ON y.lang = c.lang AND y.k = c.k - j AND y.phrase = array_to_string(c.ws[j + 1:], ' ')),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
s AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(n) AS most FROM c, unnest([1, 2]) AS t(i) WHERE k = 3 GROUP BY 1, 2),
kept AS (SELECT b.* FROM b LEFT JOIN s ON s.lang = b.lang AND s.phrase = b.phrase AND b.k = 2 WHERE s.most IS NULL OR 100 * s.most < 50 * b.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, tot.n, score
FROM kept JOIN tot ON tot.lang = kept.lang QUALIFY rank <= 2000""",
    "op13_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words("text", True, _ALNUM)} AS w FROM documents),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
t AS (SELECT rid, doc_id, len(w) AS size, term, count(*) AS tf FROM (SELECT rid, doc_id, w, unnest(w) AS term FROM d) GROUP BY 1, 2, 3, 4),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_words("text", True, _ALNUM)}) AS term FROM benchmark) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
i AS (SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size * n) // total))) AS impact FROM t JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY item_id, rid, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10""",
}
