"""SQL that the queries are held to, written independently for DuckDB."""

from __future__ import annotations

from lexstrata.fixtures import CORPUS_SQL, DATASETS_SQL
from lexstrata.functions.text import STOCK_PHRASES, TOPIC_MARKS
from lexstrata.functions.topics import GENERAL_RULES, INDIA_RULES
from lexstrata.operators.reports import SUBJECTS, THIN_SUBJECTS, TRAITS
from lexstrata.operators.views import FILLERS
from lexstrata.plans.queries import MENTION_CASES, TOPIC_CASES

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE = r"[ \t\n\x0B\f\r]"


def clip(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def style(table: str, key: str) -> str:
    """CTEs f0..f2, style: features of ``table``."""
    return rf"""
f0 AS (SELECT {key}, text, regexp_extract_all({LOW.format("text")}, '[a-z0-9'']+') AS w,
  list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g'), '[.!?]{SPACE}+'),
    lambda s: len(regexp_extract_all({LOW.format("s")}, '[a-z0-9'']+'))), lambda n: n > 0) AS s FROM {table}),
f1 AS (SELECT *, len(w) AS n, CASE WHEN len(s) > 0 THEN list_avg(s) ELSE 0.0 END AS av, CASE WHEN len(s) > 1 THEN list_stddev_samp(s) ELSE 0.0 END AS sd,
  list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM f0),
f2 AS (SELECT {key}, -sum(c / t * log2(c / t)) AS char_entropy FROM (SELECT {key}, count(*) AS c, sum(count(*)) OVER (PARTITION BY {key}) AS t
  FROM (SELECT {key}, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM {table}) GROUP BY {key}, b) GROUP BY {key}),
style AS (SELECT f1.{key}, text, n AS word_count, CASE WHEN n > 0 THEN len(list_distinct(w)) / n ELSE 0.0 END AS type_token_ratio, av AS avg_sentence_length,
  sd AS sentence_length_std, CASE WHEN av > 0 THEN sd / av ELSE 0.0 END AS burstiness,
  CASE WHEN strlen(text) > 0 THEN length(regexp_replace(text, '[^.,;:!?"''()\-]', '', 'g')) / strlen(text) ELSE 0.0 END AS punctuation_ratio,
  CASE WHEN n < 6 THEN 0.0 ELSE (len(g) - len(list_distinct(g))) / len(g) END AS repetition_score, coalesce(char_entropy, 0.0) AS char_entropy
  FROM f1 LEFT JOIN f2 ON f1.{key} = f2.{key})"""


def hit(phrase: str) -> str:
    return f"contains({LOW.format('text')}, '{phrase.replace(chr(39), chr(39) * 2)}')"


HITS = " + ".join(f"CAST({hit(p)} AS INT)" for p in STOCK_PHRASES)
DETECTORS = f"""
det AS (SELECT *, {clip(f"0.30 * {clip('1 - burstiness / 1.2')} + 0.25 * {clip('repetition_score')} + 0.25 * {clip('1 - sentence_length_std / 18')} + 0.20 * {clip('(4.6 - char_entropy) / 1.5')}")} AS detector_stylometry,
  {clip(f'({HITS}) / 4.0')} AS stock_phrases, {clip('0.6 * (1 - burstiness / 1.1) + 0.4 * (1 - sentence_length_std / 16)')} AS detector_uniformity,
  {clip('repetition_score * 1.4')} AS detector_repetition FROM style)"""


def year(c: str) -> str:
    runs = f"list_filter(list_transform(list_filter(regexp_split_to_array({c}, '[^0-9]+'), lambda x: length(x) = 4), lambda x: CAST(x AS INT)), lambda y: y BETWEEN 1900 AND 2100)"
    head = f"TRY_CAST(nullif(regexp_extract({c}, '^([0-9]{{4}})', 1), '') AS INT)"
    return f"coalesce(CASE WHEN {head} BETWEEN 1900 AND 2100 THEN {head} END, {runs}[1], 0)"


DATED = f"""
dated AS (SELECT *, CASE WHEN {year("coalesce(created_at, '')")} > 0 THEN coalesce(created_at, '') WHEN {year("coalesce(published_at, '')")} > 0 THEN coalesce(published_at, '') ELSE '' END AS date FROM c),
d AS (SELECT *, {year("date")} AS year, TRY_CAST(nullif(regexp_extract(substr(date, 1, 4), '^ *([0-9]+)', 1), '') AS INT) AS y,
  coalesce(TRY_CAST(nullif(regexp_extract(substr(date, 6, 2), '^ *([0-9]+)', 1), '') AS INT), 1) AS m, coalesce(TRY_CAST(nullif(regexp_extract(substr(date, 9, 2), '^ *([0-9]+)', 1), '') AS INT), 1) AS dd FROM dated),
rec AS (SELECT *, CASE WHEN date = '' OR y IS NULL OR y <= 0 THEN 0.45 WHEN y < 2019 THEN 0.0 WHEN y < 2022 THEN 0.20 WHEN y = 2022 AND (m < 11 OR (m = 11 AND dd < 30)) THEN 0.26
  WHEN y = 2022 THEN 0.48 ELSE {clip("0.54 + 0.05 * least(4, y - 2023) + m / 12.0 * 0.04")} END AS recency0 FROM d)"""

HASH = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({t}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda a, x: (a * 31 + x) % 4294967296)"


def slot(t: str) -> str:
    h = HASH.format(t=t)
    return f"abs(CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END) % 128"


def embedding(table: str, key: str, text: str) -> str:
    """CTE emb: ({key}, pos, v) of unit hashed vectors."""
    return f"""
e0 AS (SELECT {key}, {text} AS t FROM {table}),
e1 AS (SELECT {key}, tok, count(*) AS k FROM (SELECT {key}, unnest(regexp_extract_all({LOW.format("t")}, '[a-z0-9]{{2,}}')) AS tok FROM e0) GROUP BY ALL),
voc AS (SELECT tok, {slot("tok")} AS a, {slot("(tok || '#2')")} AS b FROM (SELECT DISTINCT tok FROM e1)),
e2 AS (SELECT {key}, a AS pos, k * 1.0 AS x FROM e1 JOIN voc USING (tok) UNION ALL SELECT {key}, b, k * 0.5 FROM e1 JOIN voc USING (tok) UNION ALL
  SELECT {key}, (CASE WHEN v >= 128 THEN v - 256 ELSE v END + 128) % 128, 0.05 FROM (SELECT {key}, CAST(('0x' || h) AS INT) AS v FROM
  (SELECT {key}, unnest(regexp_extract_all(hex(encode(t)), '(..).{{0,12}}', 1)) AS h FROM e0))),
e3 AS (SELECT {key}, pos, sum(x) AS x FROM e2 GROUP BY ALL),
emb AS (SELECT {key}, pos, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS v FROM e3)"""


def scored(by: str, source: str = "SELECT * FROM corpus0") -> str:
    """CTE scored, calibrated within ``by``, of the rows of ``source``."""
    names = ("detector_stylometry", "stock_phrases", "detector_repetition", "detector_uniformity", "distance", "type_token_ratio", "burstiness")
    base = lambda v: f"CASE WHEN pre OR NOT have_pre THEN {v} END"
    stats = ", ".join(f"avg({base(v)}) AS {v}_m, stddev_samp({base(v)}) AS {v}_s, count({base(v)}) AS {v}_n" for v in names)
    z = lambda v: f"(({v} - {v}_m) / CASE WHEN {v}_n < 2 OR {v}_s < 1e-6 THEN 1.0 ELSE {v}_s END)"
    excess = lambda v: clip(f"0.5 + 0.5 * tanh({z(v)} / 2)")
    pick = lambda v: f"CASE WHEN have_pre THEN {excess(v)} ELSE {clip(v)} END"
    rank = lambda v, p: f"CASE WHEN count(*) OVER (PARTITION BY {p}) = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY {p} ORDER BY {v}) - 1 + (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2.0) / (count(*) OVER (PARTITION BY {p}) - 1) END"
    return f"""WITH corpus0 AS ({CORPUS_SQL}), ds AS ({DATASETS_SQL}), c AS ({source}), {style("c", "id")}, {DETECTORS}, {DATED},
{embedding("c", "id", "title || chr(10) || text")},
s0 AS (SELECT rec.*, det.* EXCLUDE (id, text), year > 0 AND year < 2019 AS pre FROM rec JOIN det USING (id)),
fb AS (SELECT id AS fid FROM s0 QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY detector_stylometry, id) <= greatest(2, least(8, count(*) OVER (PARTITION BY {by}) // 6))),
cen AS (SELECT {by} AS scope_key, pos, sum(CASE WHEN pre THEN v END) AS x, sum(CASE WHEN fid IS NOT NULL THEN v END) AS xa, bool_or(pre) AS has FROM emb JOIN s0 USING (id) LEFT JOIN fb ON fid = id GROUP BY ALL),
hp AS (SELECT scope_key, bool_or(has) AS have_pre FROM cen GROUP BY ALL),
cen2 AS (SELECT scope_key, pos, CASE WHEN have_pre THEN coalesce(x, 0) ELSE coalesce(xa, 0) END AS x, have_pre FROM cen JOIN hp USING (scope_key)),
nrm AS (SELECT scope_key, sqrt(sum(x * x)) AS nn FROM cen2 GROUP BY ALL),
dst AS (SELECT s0.id, round(1 - sum(v * coalesce(x, 0)) / any_value(nn), 9) AS distance, any_value(hp.have_pre) AS have_pre FROM s0 JOIN emb USING (id) JOIN hp ON hp.scope_key = s0.{by} JOIN nrm ON nrm.scope_key = s0.{by}
  LEFT JOIN cen2 ON cen2.scope_key = s0.{by} AND cen2.pos = emb.pos GROUP BY s0.id),
s1 AS (SELECT *, distance AS dq FROM s0 JOIN dst USING (id)),
st AS (SELECT {by}, {stats} FROM s1 GROUP BY {by}),
s2 AS (SELECT *, {rank("dq", by)} AS arank FROM s1 JOIN st USING ({by})),
s3 AS (SELECT *, {clip(f"0.45 * CASE WHEN have_pre THEN {excess('distance')} ELSE {clip('1.4 * distance')} END + 0.55 * arank")} AS anomaly, {pick("detector_stylometry")} AS stylometry, {pick("stock_phrases")} AS stock,
  {pick("detector_repetition")} AS ngram, {pick("detector_uniformity")} AS uniformity, {clip(f"(abs({z('type_token_ratio')}) + abs({z('burstiness')})) / 6")} AS deviation,
  CASE WHEN pre THEN 0.0 ELSE recency0 END AS recency FROM s2),
s4 AS (SELECT *, round(1 / (1 + exp(-(0.58 + 0.70 * (stylometry - 0.5) + 1.10 * (stock - 0.5) + 0.85 * (uniformity - 0.5) + 0.28 * (ngram - 0.5) + 0.50 * (anomaly - 0.5) + 0.30 * (deviation - 0.5) + 1.15 * (recency - 0.45)))), 9) AS raw_p,
  least(0.22, 0.06 + 0.45 * list_stddev_pop([stylometry, uniformity, recency])) AS half FROM s3),
s5 AS (SELECT *, raw_p AS pq, {clip("raw_p + half")} - {clip("raw_p - half")} AS width FROM s4),
s6 AS (SELECT *, CASE WHEN pre THEN {clip(f"0.025 + 0.04 * {clip('detector_stylometry')}")} ELSE {clip(f"0.62 * raw_p + 0.38 * ({rank('pq', by + ', pre')})")} END AS p_ai FROM s5),
s7 AS (SELECT *, {clip("p_ai - CASE WHEN pre THEN 0.03 ELSE greatest(0.05, width / 2) END")} AS ci_low, {clip("p_ai + CASE WHEN pre THEN 0.08 ELSE greatest(0.05, width / 2) END")} AS ci_high FROM s6),
scored AS (SELECT *, CASE WHEN pre THEN 'LIKELY_HUMAN' WHEN round(ci_high - ci_low, 9) > 0.5 THEN 'UNCERTAIN' WHEN round(p_ai, 9) >= 0.58 THEN 'LIKELY_AI' WHEN round(p_ai, 9) <= 0.42 THEN 'LIKELY_HUMAN' ELSE 'UNCERTAIN' END AS band FROM s7)"""


TOPIC = "CASE WHEN lower(trim(topic)) IN ('india', 'germany', 'australia', 'united states') THEN topic WHEN lower(trim(topic)) IN ('usa', 'us', 'united states of america') THEN 'United States' ELSE '' END"
SUBTOPIC = "CASE WHEN topic = 'computer_science' THEN 'Computer science' ELSE '' END"
#: Canonical topic of the corpus's own topics, whose titles name nothing.
CANONICAL = "CASE WHEN topic = '' THEN 'General' ELSE topic END"
DOCYEAR = f"coalesce(nullif({year('coalesce(created_at, chr(32))')}, 0), {year('coalesce(published_at, chr(32))')})"
ALL = f"SELECT * EXCLUDE (topic), {TOPIC} AS topic, {SUBTOPIC} AS subtopic, 0 AS scope FROM corpus0 WHERE dataset_id IN (SELECT dataset_id FROM ds WHERE kind <> 'WIKIPEDIA_SUBSET')"
VIEW = scored("scope", ALL)
STORED = scored("dataset_id", ALL)
INDIA = scored("scope", f"SELECT * FROM ({ALL}) WHERE dataset_id = 1 AND topic = 'India'")
COLLECTION = "CASE dataset_id WHEN 1 THEN 'Wikipedia' WHEN 2 THEN 'GDELT' ELSE 'uploads' END"


def third(v: str) -> str:
    return f"round(round({v}, 9), 3)"


def percent(v: str) -> str:
    return f"CAST(round(round(100 * {clip(v)}, 9)) AS INT)"


def interval(v: str = "p_ai") -> str:
    err = f"CASE WHEN count({v}) = 0 THEN 0.0 ELSE 1.96 * CASE WHEN count({v}) < 2 THEN 0.08 ELSE stddev_samp({v}) / sqrt(count({v})) END END"
    m = f"coalesce(avg({v}), 0.0)"
    return f"round(round({m}, 6), 4) AS mean, round(round({clip(f'{m} - {err}')}, 6), 4) AS low, round(round({clip(f'{m} + {err}')}, 6), 4) AS high"


SIGNALS = {"p_ai": "p_ai", "stylometry": "detector_stylometry", "stock_phrases": "round(round(stock, 9), 3)", "uniformity": "detector_uniformity", "ngrams": "detector_repetition", "embedding_anomaly": "anomaly", "stylometry_deviation": "deviation", "post_chatgpt": "round(round(recency, 9), 3)"}


def summary(source: str = "scored", words: bool = False) -> str:
    e = "1.96 * CASE WHEN count(p_ai) < 2 THEN 0.08 ELSE stddev_samp(p_ai) / sqrt(count(p_ai)) END"
    share = "round(coalesce(sum(p_ai * word_count) / nullif(sum(word_count), 0), 0.0), 6)"
    low, high = (f"{share} - {e}", f"{share} + {e}") if words else ("round(" + clip(f"avg(p_ai) - {e}") + ", 6)", "round(" + clip(f"avg(p_ai) + {e}") + ", 6)")
    return f"""SELECT count(*) AS documents, count(p_ai) AS scored, {interval()}, round({share}, 4) AS word_share, CAST(sum(word_count) AS BIGINT) AS words,
count(*) FILTER (band = 'LIKELY_AI') AS likely_ai, count(*) FILTER (band = 'UNCERTAIN') AS uncertain, count(*) FILTER (band = 'LIKELY_HUMAN') AS likely_human,
{", ".join(f"round({third(f'avg({c})')}, 4) AS mean_{k}" for k, c in SIGNALS.items())}, {percent(share if words else "round(avg(p_ai), 6)")} AS estimate, {percent(low)} AS estimate_low, {percent(high)} AS estimate_high FROM {source}"""


YEARS = "yr AS (SELECT year, count(*) AS documents, round(avg(p_ai), 6) AS mean, round(" + clip("avg(p_ai) - 1.96 * CASE WHEN count(*) < 2 THEN 0.08 ELSE stddev_samp(p_ai) / sqrt(count(*)) END") + ", 6) AS low, round(" + clip("avg(p_ai) + 1.96 * CASE WHEN count(*) < 2 THEN 0.08 ELSE stddev_samp(p_ai) / sqrt(count(*)) END") + ", 6) AS high FROM scored WHERE year >= 2015 GROUP BY year)"
PAIRS = """WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS l FROM embeddings),
p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * b.embedding[i])) / (a.l * b.l), 9) AS cosine
  FROM n a JOIN n b ON a.vec_id <> b.vec_id),
edges AS (SELECT src, dst, cosine FROM p WHERE cosine >= 0.32 QUALIFY row_number() OVER (PARTITION BY src ORDER BY cosine DESC, dst) <= 8)"""
GUESS = "CASE " + " ".join("WHEN " + " OR ".join(hit(m) for m in marks) + f" THEN '{t}'" for t, marks in TOPIC_MARKS) + " ELSE 'general' END"
NORMAL = r"""nu AS (SELECT page_id, url, lower(regexp_extract(url, '^([^:/]*)://', 1)) AS sch, regexp_replace(url, '^[^:/]*://', '') AS rest FROM {src}),
nv AS (SELECT *, lower(regexp_extract(rest, '^([^/?:]*)', 1)) AS host, regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+', '/', 'g') AS path, regexp_extract(rest, '\?(.*)$', 1) AS qs FROM nu),
nw AS (SELECT *, sch || '://' || host || CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END || CASE WHEN qs = '' THEN '' ELSE '?' || qs END AS normal FROM nv)"""
SUBJECT = "CASE " + " ".join(f"WHEN regexp_matches(lower(title || ' ' || subtopic), '{p}') THEN '{n}'" for n, p in SUBJECTS) + " ELSE '' END"
TEXT_SUBJECT = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in SUBJECTS) + " ELSE '' END"
WIKI = scored("dataset_id", f"SELECT * EXCLUDE (topic), {CANONICAL} AS topic FROM corpus0 WHERE dataset_id = 1")
POOLS = "pools AS (SELECT topic, count(*) AS documents, count(*) FILTER (year > 0) AS dated, count(*) FILTER (year > 0 AND year < 2019) AS before_pool, count(*) FILTER (year >= 2019) AS after_pool FROM {src} WHERE topic <> '' GROUP BY topic HAVING count(*) >= 100)"
COHORT = f"""{WIKI}, {POOLS.format(src="scored")},
pick AS (SELECT *, year >= 2019 AS late, row_number() OVER (PARTITION BY topic, year >= 2019 ORDER BY date, id) - 1 AS r, count(*) OVER (PARTITION BY topic, year >= 2019) AS n
  FROM scored WHERE year > 0 AND topic IN (SELECT topic FROM pools WHERE before_pool >= 50 AND after_pool >= 50)),
smp AS (SELECT * FROM pick WHERE r IN (SELECT i * (n - 1) // 49 FROM range(50) x(i))),
mid AS (SELECT topic, pos, sum(v) AS x FROM smp JOIN emb USING (id) WHERE NOT late GROUP BY ALL),
far AS (SELECT smp.id, 1 - sum(v * coalesce(x, 0)) / any_value(nn) AS _far FROM smp JOIN emb USING (id) LEFT JOIN mid USING (topic, pos)
  JOIN (SELECT topic, sqrt(sum(x * x)) AS nn FROM mid GROUP BY topic) USING (topic) GROUP BY smp.id),
tr AS (SELECT topic, unnest([{", ".join(f"'{k}'" for k, _, _ in TRAITS)}]) AS trait, unnest([{", ".join(f"coalesce(avg({'round(round(stock, 9), 3)' if c == 'stock' else c}) FILTER (NOT late), 0.0)" for _, c, _ in TRAITS)}]) AS b,
  unnest([{", ".join(f"coalesce(avg({'round(round(stock, 9), 3)' if c == 'stock' else c}) FILTER (late), 0.0)" for _, c, _ in TRAITS)}]) AS a, unnest([{", ".join(str(u).lower() for _, _, u in TRAITS)}]) AS up FROM smp JOIN far USING (id) GROUP BY topic)"""
DS = f"WITH corpus0 AS ({CORPUS_SQL}), ds AS ({DATASETS_SQL}), c AS (SELECT * FROM corpus0)"

ORACLES = {
    "doc_style": f"WITH {style('documents', 'doc_id')} SELECT doc_id, CAST(word_count AS INT) AS word_count, {', '.join(f'round({x}, 6) AS {x}' for x in ('type_token_ratio', 'avg_sentence_length', 'sentence_length_std', 'burstiness', 'punctuation_ratio', 'repetition_score'))} FROM style",
    "doc_entropy": f"WITH {style('documents', 'doc_id')} SELECT doc_id, round(char_entropy, 6) AS char_entropy FROM style",
    "doc_detectors": f"{DS}, {style('c', 'id')}, {DETECTORS} SELECT id, {', '.join(f'round({x}, 6) AS {x}' for x in ('detector_stylometry', 'stock_phrases', 'detector_uniformity', 'detector_repetition'))} FROM det",
    "doc_topic_guess": f"{DS} SELECT {GUESS} AS guess, count(*) AS documents FROM c GROUP BY 1",
    "doc_dates": f"{DS}, {DATED} SELECT id, date, year, round(recency0, 6) AS recency FROM rec",
    "doc_hashed_embedding": f"WITH {embedding('documents', 'doc_id', 'text')} SELECT doc_id, CAST(pos AS INT) AS pos, round(v, 6) AS val FROM emb",
    "stock_phrase_df": f"{DS} " + " UNION ALL ".join(f"SELECT '{p.replace(chr(39), chr(39) * 2)}' AS phrase, count(*) AS documents FROM c WHERE {hit(p)} HAVING count(*) > 0" for p in STOCK_PHRASES),
    "vec_centroid_by_label": "WITH m AS (SELECT label, i - 1 AS pos, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL) SELECT label, CAST(pos AS INT) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) AS val FROM m",
    "knn_edges_vec": f"{PAIRS} SELECT src, dst, round(cosine, 5) AS cosine FROM edges",
    "graph_visible_edges": f"{PAIRS} SELECT src, dst FROM edges WHERE src IN (SELECT vec_id FROM embeddings WHERE label < 5) AND dst IN (SELECT vec_id FROM embeddings WHERE label < 5)",
    "graph_undirected": f"{PAIRS} SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(max(cosine), 5) AS cosine FROM edges GROUP BY 1, 2",
    "graph_mean_aggregate": f"{PAIRS}, r AS (SELECT src AS id, dst AS other FROM edges UNION ALL SELECT vec_id, vec_id FROM embeddings), x AS (SELECT id, embedding, unnest(range(1, 9)) AS i FROM r JOIN embeddings ON other = vec_id) SELECT id, CAST(i - 1 AS INT) AS i, round(avg(CAST(embedding[i] AS DOUBLE)), 5) AS mean FROM x GROUP BY 1, x.i",
    "era_scores": f"{scored('dataset_id')} SELECT id, dataset_id, {', '.join(f'round({x}, 4) AS {x}' for x in ('stylometry', 'stock', 'uniformity', 'ngram', 'anomaly', 'deviation', 'recency', 'p_ai', 'ci_low', 'ci_high'))}, band FROM scored",
    "breakdown_source": f"{VIEW} SELECT trim(source) AS key, count(*) AS documents, {interval()} FROM scored WHERE trim(source) <> '' GROUP BY 1",
    "group_fold": "WITH g AS (SELECT source AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lower(source)) AS r FROM documents GROUP BY source) SELECT CASE WHEN r <= 7 THEN name ELSE 'Other (remaining groups)' END AS name, CAST(sum(n) AS BIGINT) AS documents FROM g GROUP BY 1",
    "era_compare_sept": f"{VIEW}, x AS (SELECT p_ai, CASE WHEN regexp_matches(date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN date >= '2019-09-01' ELSE year > 2019 END AS late FROM scored WHERE date <> '' AND year > 0 AND date <> '2019') SELECT count(*) FILTER (NOT late) AS n_before, count(*) FILTER (late) AS n_after, round(round(avg(p_ai) FILTER (NOT late), 6), 4) AS mean_before, round(round(avg(p_ai) FILTER (late), 6), 4) AS mean_after FROM x",
    "subject_mix": f"{VIEW}, g AS (SELECT 'title' AS told_by, {SUBJECT} AS subject, p_ai FROM scored UNION ALL SELECT 'text', {TEXT_SUBJECT}, p_ai FROM scored) SELECT told_by, subject, count(*) AS documents, round(round(count(*) / (SELECT count(*) FROM scored), 6), 4) AS share, round(round(avg(p_ai), 6), 4) AS mean FROM g WHERE subject <> '' GROUP BY told_by, subject",
    "year_span_mode": f"{DS}, {DATED}, y AS (SELECT year, count(*) AS n FROM rec WHERE year > 0 GROUP BY year) SELECT CAST(sum(n) AS BIGINT) AS dated, CAST(min(year) AS INT) AS first, CAST(max(year) AS INT) AS last, (SELECT CAST(year AS INT) FROM y ORDER BY n DESC, year LIMIT 1) AS mode_year, round(round(max(n) / sum(n), 6), 4) AS peak_share, max(n) / sum(n) >= 0.6 AS peaked FROM y",
    "breakdown_merge": "WITH p AS (SELECT source, lang, count(*) AS n, round(avg(n_chars % 100 / 100), 6) AS m, min(n_chars % 100 / 100) AS lo, max(n_chars % 100 / 100) AS hi FROM documents GROUP BY ALL) SELECT source AS key, CAST(sum(n) AS BIGINT) AS documents, round(round(sum(m * n) / sum(n), 6), 4) AS mean, round(min(lo), 4) AS low, round(max(hi), 4) AS high FROM p WHERE source <> '' GROUP BY source",
    "era_cohort_traits": f"{COHORT} SELECT topic, trait, round(round(b, 6), 4) AS before, round(round(a, 6), 4) AS after, CASE WHEN up THEN round(a, 6) - round(b, 6) > 0.02 ELSE round(b, 6) - round(a, 6) > 0.02 END AS ai_like FROM tr",
    "url_normalize": f"WITH {NORMAL.format(src='pages')} SELECT page_id, normal, host, regexp_replace(normal, '^https?://(www\\.)?', '') AS key, true AS public FROM nw",
    "url_dedup": f"WITH v AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, 'https://' || regexp_replace(url, '^https?://', '') FROM pages UNION ALL SELECT page_id, url || '/' FROM pages), {NORMAL.format(src='v')} SELECT regexp_replace(normal, '^https?://(www\\.)?', '') AS key, min(page_id) AS first_page, count(*) AS n FROM nw GROUP BY 1",
    "crawl_frontier": "WITH RECURSIVE r AS (SELECT page_id AS page, 0 AS depth FROM pages WHERE page_id = 0 UNION ALL SELECT p.page_id, depth + 1 FROM r JOIN pages p ON p.page_id IN (r.page * 2 + 1, r.page * 2 + 2) WHERE depth < 4) SELECT page, depth FROM r",
    "run_progress": "SELECT event_type AS task_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, round(sum(value), 2) AS ms FROM events GROUP BY 1",
}

_HOP = "SELECT id, i, sum(x) / (1 + any_value(n)) AS x FROM (SELECT id, i, x FROM {0} UNION ALL SELECT s, i, x FROM pairs2 JOIN {0} ON {0}.id = d) q JOIN deg USING (id) GROUP BY id, i"
_ENDS = "[('', false), ('/a.PDF', true), ('/a.pdfx', false), ('/a.json?x=1', true), ('/b.tar.gz', true), ('/c.js/d', true)]"
_SIDE = "SELECT year, count(*) AS n, round(avg(x) FILTER (id % 2 = 0), 6) AS m FROM z WHERE id % 3 {} 0 GROUP BY year"
ORACLES |= {
    "graph_two_hop": f"{PAIRS}, pairs2 AS (SELECT src AS s, dst AS d FROM edges UNION ALL SELECT dst, src FROM edges), deg AS (SELECT vec_id AS id, count(d) AS n FROM embeddings LEFT JOIN pairs2 ON s = vec_id GROUP BY 1), h0 AS (SELECT vec_id AS id, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 9) r(i)), h1 AS ({_HOP.format('h0')}), h2 AS ({_HOP.format('h1')}) SELECT id, CAST(i AS INT) AS i, round(x, 5) AS mean FROM h2",
    "graph_orphans": f"{PAIRS} SELECT src, dst FROM edges WHERE src IN (SELECT vec_id FROM embeddings WHERE label <> 3)",
    "field_share_max": "SELECT trim(source) AS key, CAST(floor(round(avg(n_chars % 100 / 100) * 100, 6) + 0.5) AS BIGINT) AS percent, count(*) AS documents FROM documents WHERE trim(source) <> '' AND (SELECT count(DISTINCT trim(source)) FROM documents) > 1 GROUP BY 1 HAVING count(*) >= 20 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1",
    "year_rows": f"{DS}, {DATED}, z AS (SELECT id, year, length(text) % 100 / 100 AS x FROM d), p AS ({_SIDE.format('=')}), q AS ({_SIDE.format('<>')}), b AS (SELECT year, CASE WHEN p.n IS NULL OR q.n > p.n OR (p.m IS NULL AND q.m IS NOT NULL) THEN q.n ELSE p.n END AS n, CASE WHEN p.n IS NULL OR q.n > p.n OR (p.m IS NULL AND q.m IS NOT NULL) THEN q.m ELSE p.m END AS m FROM p FULL JOIN q USING (year) WHERE year BETWEEN 2015 AND 2026) SELECT CAST(y AS INT) AS year, coalesce(n, 0) AS documents, round(m, 4) AS mean FROM (SELECT unnest(range(2015, (SELECT max(year) FROM b) + 1)) AS y) LEFT JOIN b ON b.year = y",
    "created_collapsed": f"{DS}, z AS (SELECT dataset_id, coalesce(TRY_CAST(nullif(regexp_extract(created_at, '^([0-9]{{4}})', 1), '') AS INT), 0) AS y FROM c) SELECT dataset_id, count(*) AS documents, count(*) FILTER (y <= 0 OR y = 2016) AS bad, count(DISTINCT y) FILTER (y > 0) AS years, 2 * count(*) FILTER (y <= 0 OR y = 2016) >= count(*) OR count(DISTINCT y) FILTER (y > 0) <= 1 AS collapsed FROM z GROUP BY 1",
    "revision_dates": f"{DS}, z AS (SELECT title, created_at FROM c WHERE regexp_matches(created_at, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) SELECT title, created_at AS date FROM z UNION ALL SELECT upper(title), created_at FROM z",
    "url_skippable": f"SELECT page_id, CAST(k - 1 AS INT) AS k, CASE WHEN k = 1 THEN regexp_matches(lower(split_part(url, '?', 1)), '\\.(pdf|zip|png|jpg|css|js|json|csv)$') WHEN contains(url, '?') THEN regexp_matches(lower(split_part(url, '?', 1)), '\\.(pdf|zip|png|jpg|css|js|json|csv)$') ELSE ({_ENDS})[k][2] END AS skip FROM (SELECT page_id, url, unnest(range(1, 7)) AS k FROM pages)",
    "title_filters": f"{DS}, z AS (SELECT id, id % 7 AS s, CASE WHEN id % 3 = 0 THEN 'It May refer to ' ELSE '' END || text AS t FROM c) SELECT id, s NOT IN (1, 2, 3, 4) AS article, id % 11 = 0 OR (contains({LOW.format('substr(t, 1, 180)')}, 'may refer to') AND len(regexp_extract_all({LOW.format('t')}, '[a-z0-9'']+')) < 120) AS pointer FROM z",
}

SUMMARY = summary()
DENSE = """, dense AS (SELECT id, list(coalesce(v, 0.0) ORDER BY p) AS vec FROM (SELECT id, p FROM (SELECT DISTINCT id FROM emb), range(128) r(p)) LEFT JOIN (SELECT id AS id2, pos, v FROM emb) ON id2 = id AND pos = p GROUP BY id)"""


def edges(source: str, k: int = 8) -> str:
    """CTEs dense, de: neighbours of the documents of ``source`` (id, topic, source)."""
    return f"""{DENSE}, nd AS (SELECT n.id, n.topic, n.source, vec FROM {source} n JOIN dense USING (id)),
dp AS (SELECT a.id AS src, b.id AS dst, round(list_dot_product(a.vec, b.vec), 9) AS cosine, a.topic <> '' AND a.topic = b.topic AS st, a.source <> '' AND a.source = b.source AS ss FROM nd a JOIN nd b ON a.id <> b.id),
de AS (SELECT src, dst, cosine, 'embedding' || CASE WHEN st THEN '+topic' ELSE '' END || CASE WHEN ss THEN '+source' ELSE '' END AS reason FROM dp WHERE cosine >= 0.32 OR st
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(cosine + 0.08 * CAST(st AS INT) + 0.04 * CAST(ss AS INT), 9) DESC, dst) <= {k})"""


def first_label(v: str, rules: tuple) -> str:
    flat = [(label, n) for label, ns in rules for n in ns]
    needles = "[" + ", ".join(f"'{n}'" for _, n in flat) + "]"
    labels = "[" + ", ".join(f"'{x}'" for x, _ in flat) + "]"
    return f"coalesce(({labels})[list_position({needles}, list_filter({needles}, lambda n: contains({LOW.format(v)}, n))[1])], '')"


def says(low: str) -> dict[str, str]:
    word = lambda w: f"regexp_matches({low}, '(^|[^a-z0-9]){w}($|[^a-z0-9])')"
    return {
        "United States": f"(contains({low}, 'united states') OR contains({low}, 'u.s.a') OR contains({low}, 'u.s.') OR {word('usa')})",
        "Germany": f"(contains({low}, 'germany') OR contains({low}, 'deutschland') OR {word('german')} OR {word('germans')})",
        "Australia": f"contains({low}, 'australia')",
    }


def kept(v: str) -> str:
    low = f"lower(trim({v}))"
    return f"CASE WHEN {low} = 'india' THEN 'India' WHEN {low} = 'geography of india' THEN 'Geography of India' WHEN {low} IN ('united states', 'usa', 'us', 'united states of america') THEN 'United States' WHEN {low} = 'germany' THEN 'Germany' WHEN {low} = 'australia' THEN 'Australia' ELSE '' END"


def country(title: str, text: str) -> str:
    a, b = says(LOW.format(title)), says(LOW.format(f"({title} || ' | ' || {text})"))
    cases = [f"WHEN {kept(title)} IN ('United States', 'Germany', 'Australia') THEN {kept(title)}"]
    for found in (a, {c: f"({a[c]} OR {b[c]})" for c in a}):
        cases += [f"WHEN {found[c]} AND NOT ({' OR '.join(found[o] for o in found if o != c)}) THEN '{c}'" for c in found]
    return f"CASE {' '.join(cases)} ELSE '' END"


_NEEDLES = [n for _, ns in (*INDIA_RULES, *GENERAL_RULES) for n in ns] + list(MENTION_CASES)
_LIST = lambda xs: "[" + ", ".join("'" + x + "'" for x in xs) + "]"
CASES = f"""{DS}, tc0 AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'Plain' ELSE 'On ' || ({_LIST(_NEEDLES)})[id % {len(_NEEDLES)} + 1] || ' 2' END AS title, ({_LIST(TOPIC_CASES)})[id % {len(TOPIC_CASES)} + 1] AS topic FROM c),
tc1 AS (SELECT *, {first_label("title", INDIA_RULES)} AS label, {first_label("(title || ' | ' || topic)", INDIA_RULES)} AS mapped, {first_label("title", GENERAL_RULES)} AS general, {country("title", "topic")} AS country,
  {country("title", "trim(topic)")} AS inferred1, {country("title", "title")} AS inferred2, {kept("topic")} AS kt, {kept("title")} AS kn FROM tc0),
tc2 AS (SELECT *, CASE WHEN kt <> '' THEN kt WHEN kn <> '' THEN kn WHEN country <> '' THEN country WHEN mapped = 'Geography of India' THEN mapped WHEN mapped <> '' THEN 'India' WHEN trim(topic) <> '' THEN trim(topic) ELSE 'General' END AS canonical FROM tc1),
tc3 AS (SELECT *, CASE WHEN lower(canonical) = 'geography of india' THEN 'India' ELSE canonical END AS display, CASE WHEN inferred1 <> '' THEN inferred1 ELSE inferred2 END AS inferred,
  CASE trim(topic) WHEN 'usa' THEN 'Usa' WHEN 'computer_science' THEN 'Computer science' WHEN 'politics of germany' THEN 'Politics Of Germany' WHEN '3d_model making' THEN '3D Model Making' ELSE '' END AS pretty FROM tc2)"""
_FILL = ", ".join(repr(w) for w in FILLERS)
_HOSTED = f"{NORMAL.format(src='pages')}, pg AS (SELECT page_id, normal, regexp_extract(normal, '^(https?://[^/]*)', 1) AS origin, split_part(regexp_replace(normal, '^https?://[^/]*', ''), '?', 1) AS path FROM nw), pd AS (SELECT *, regexp_extract(path, '^(.*/)', 1) AS dir FROM pg)"
_EXAMPLE = "(SELECT topic, documents, round(mean, 4) AS mean, band, '{0}' AS asked FROM (SELECT topic, count(*) AS documents, round(avg(p_ai), 6) AS mean, CASE WHEN round(avg(p_ai), 6) >= 0.58 THEN 'LIKELY_AI' WHEN round(avg(p_ai), 6) <= 0.42 THEN 'LIKELY_HUMAN' ELSE 'UNCERTAIN' END AS band FROM scored WHERE topic <> '' GROUP BY 1 HAVING count(*) >= 20) WHERE '{0}' IN ('', band) ORDER BY {1}, lower(topic) LIMIT {2})"
_STORE = f"""{DS.replace('SELECT * FROM corpus0', 'SELECT id, CASE WHEN id % 97 = 5 THEN 77 ELSE dataset_id END AS dataset_id, title, length(text) AS n FROM corpus0')}, e AS (SELECT dataset_id, id AS src, id + 1 AS dst FROM c)"""
_ODD = [
    ("'http://www.a.com/x/y'", "'www.a.com'", True, "'/x/y'", "'a.com'", "NULL"), ("'https://a.com/'", "'a.com'", True, "'/'", "'a.com'", "NULL"), ("'https://b.org/?q=1'", "'b.org'", True, "'/'", "'b.org'", "NULL"),
    ("NULL", "NULL", False, "NULL", "NULL", "NULL"), ("NULL", "NULL", False, "NULL", "NULL", "NULL"), ("'https://10.1.2.3/'", "'10.1.2.3'", False, "'/'", "'10.1.2.3'", "NULL"),
    ("'http://h:99/'", "'h'", True, "'/'", "'h'", "NULL"), ("'http://localhost/a'", "'localhost'", False, "'/a'", "'localhost'", "NULL"), ("'https://x.local/'", "'x.local'", False, "'/'", "'x.local'", "NULL"),
    ("'http://172.16.0.1/'", "'172.16.0.1'", False, "'/'", "'172.16.0.1'", "NULL"), ("'http://172.32.0.1/'", "'172.32.0.1'", True, "'/'", "'172.32.0.1'", "NULL"), ("'http://192.168.1.1/'", "'192.168.1.1'", False, "'/'", "'192.168.1.1'", "NULL"),
    ("'http://169.254.3.4/x'", "'169.254.3.4'", False, "'/x'", "'169.254.3.4'", "NULL"), ("'https://127.0.0.1:8080/'", "'127.0.0.1'", False, "'/'", "'127.0.0.1'", "NULL"), ("'http://0.0.0.0/'", "'0.0.0.0'", False, "'/'", "'0.0.0.0'", "NULL"),
    ("'http://www.b.org:443/'", "'www.b.org'", True, "'/'", "'b.org'", "NULL"), ("'https://b.org/'", "'b.org'", True, "'/'", "'b.org'", "NULL"), ("NULL", "NULL", False, "NULL", "NULL", "NULL"), ("NULL", "NULL", False, "NULL", "NULL", "NULL"),
    ("'http://a.com/wiki/A_b%20c+d?x=1'", "'a.com'", True, "'/wiki/A_b%20c+d'", "'a.com'", "'A_b c d'"),
]
_TO = {
    "//other.org/a": "'https://other.org/a'", "http://x.org//b/": "'http://x.org/b'", "/root": "origin || '/root'", "leaf.html": "origin || dir || 'leaf.html'", "a/../b?q=1": "origin || dir || 'a/../b?q=1'",
    "?only=query": "origin || CASE WHEN dir = '/' THEN '/' ELSE rtrim(dir, '/') END || '?only=query'", " /spaced ": "origin || '/spaced'",
}
_HREFS = ("", "#top", "mailto:a@b.c", "JavaScript:void(0)", "tel:1", "data:x", "ftp://x", *_TO)
_PLAIN_PAGE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"""
_TEXTED = lambda v: f"replace(replace(replace(replace({v}, '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_PLACES = "['Delhi, India', 'Berlin, Germany;Texas, United States', 'Paris, France', 'Sydney, Australia', 'x;India', 'Germany']"
_NEWS = f"""{NORMAL.format(src='pages')}, nl AS (SELECT page_id, normal AS url, 'src' || page_id % 3 AS source, ({_PLACES})[page_id % 6 + 1] AS loc, page_id % 10 = 3 AS us FROM nw),
nt AS (SELECT *, list_filter([CASE WHEN contains(loc, 'India') THEN 'India' END, CASE WHEN us OR contains(loc, 'United States') THEN 'United States' END, CASE WHEN contains(loc, 'Germany') THEN 'Germany' END, CASE WHEN contains(loc, 'Australia') THEN 'Australia' END], lambda x: x IS NOT NULL) AS ts FROM nl)"""
_FORMS = [("'https://en.wikipedia.org/wiki/' || d", "url", "d", True), ("'http://en.m.wikipedia.org/wiki/' || d || '?x=1'", "'https://en.wikipedia.org/wiki/' || d", "d", True), ("'https://en.wikipedia.org/wiki/Talk:' || d", "url", "'Talk:' || d", False),
          ("'https://de.wikipedia.org/wiki/' || d", "url", "d", False), ("'https://en.wikipedia.org/wiki/Category:' || d", "url", "'Category:' || d", True), ("'https://en.wikipedia.org/w/' || d", "url", "NULL", False)]
_STATE = "CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 9 = 0 THEN 'running' WHEN event_id % 9 = 1 THEN 'ready' WHEN event_id % 9 = 2 THEN 'cached' ELSE 'complete' END"
_SCORES = ", ".join(f"round({x}, 4) AS {x}" for x in ("stylometry", "stock", "uniformity", "ngram", "anomaly", "deviation", "recency", "p_ai", "ci_low", "ci_high"))
ORACLES |= {
    "summary_documents": f"{VIEW} {SUMMARY}",
    "summary_words": f"{VIEW} {summary(words=True)}",
    "summary_topic_view": f"{INDIA} {SUMMARY}",
    "summary_id_view": f"{scored('scope', f'SELECT * FROM ({ALL}) WHERE id % 3 = 0')} {SUMMARY}",
    "summary_keeps_stored": f"{STORED} {summary('(SELECT * FROM scored WHERE year >= 2019)')}",
    "summary_comparison": f"SELECT * FROM ({scored('scope', f'SELECT * FROM ({ALL}) WHERE dataset_id = 3')} SELECT count(*) AS this_documents, {percent('round(avg(p_ai), 6)')} AS this_estimate FROM scored), ({scored('dataset_id', f'SELECT * FROM ({ALL}) WHERE dataset_id = 1')} SELECT count(*) AS other_documents, {percent('round(avg(p_ai), 6)')} AS other_estimate FROM scored)",
    "era_scores_no_baseline": f"{scored('dataset_id', f'SELECT * FROM corpus0 WHERE {DOCYEAR} >= 2019 OR {DOCYEAR} = 0')} SELECT id, dataset_id, {_SCORES}, band FROM scored",
    "vec_anomaly": "WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL), u AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m), e AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)), d AS (SELECT vec_id, label, 1 - sum(v * x) / sqrt(sum(v * v)) AS d FROM e JOIN u USING (label, i) GROUP BY ALL) SELECT vec_id, label, round(round(d, 9), 4) AS distance, round((rank() OVER w - 1 + (count(*) OVER (PARTITION BY label, round(d, 9)) - 1) / 2.0) / (count(*) OVER (PARTITION BY label) - 1), 6) AS rank FROM d WINDOW w AS (PARTITION BY label ORDER BY round(d, 9))",
    "knn_edges_docs": f"{DS}, {embedding('c', 'id', 'title || chr(10) || text')}, v AS ({ALL}){edges('v')} SELECT src, dst, round(cosine, 5) AS cosine, reason FROM de",
    "doc_neighbours": f"{DS}, {embedding('c', 'id', 'title || chr(10) || text')}, v AS ({ALL}){edges('v')} SELECT src, dst AS id, title, round(cosine, 3) AS cosine, reason FROM de JOIN v ON v.id = dst WHERE src % 100 = 7",
    "graph_sample": f"{DS}, {embedding('c', 'id', 'title || chr(10) || text')}, v AS ({ALL}){edges('v')}, dg AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM de UNION ALL SELECT dst FROM de) GROUP BY 1), ch AS (SELECT id FROM dg ORDER BY k DESC, CAST(id AS VARCHAR) LIMIT 60), rs AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM v WHERE id NOT IN (SELECT id FROM ch)) SELECT id FROM ch UNION ALL SELECT id FROM rs WHERE i % greatest(1, n // 40) = 0 AND i // greatest(1, n // 40) < 40",
    "graph_node_means": f"{scored('dataset_id', 'SELECT * FROM corpus0 WHERE dataset_id = 2')}{edges('c', 3)}, f AS (SELECT id, unnest(range(8)) AS i, unnest([detector_stylometry, detector_repetition, detector_uniformity, anomaly, deviation, type_token_ratio, burstiness, p_ai]) AS x FROM scored) SELECT q.id, CAST(i AS INT) AS i, round(avg(x), 4) AS mean FROM (SELECT src AS id, dst AS other FROM de UNION ALL SELECT id, id FROM scored) q JOIN f ON f.id = other GROUP BY q.id, f.i",
    "graph_groups": f"{DS}, v AS ({ALL}), g AS (SELECT topic AS key, count(*) AS documents, 'topic' AS how FROM v WHERE topic <> '' GROUP BY 1 HAVING count(*) >= 20 UNION ALL SELECT {COLLECTION}, count(*), 'dataset' FROM v GROUP BY 1) SELECT key, documents, CAST(row_number() OVER (PARTITION BY how ORDER BY documents DESC, lower(key)) AS INT) AS place, how FROM g",
    "graph_nodes": f"{VIEW} SELECT id, title, band, round(p_ai, 4) AS p_ai, topic, nullif(subtopic, '') AS subtopic, source, CASE dataset_id WHEN 1 THEN 'Wikipedia' WHEN 2 THEN 'GDELT' ELSE 'Unknown collection' END AS collection, CASE WHEN topic = '' THEN 'Uncategorized' ELSE topic END AS \"group\" FROM scored",
    "breakdown_topic": f"{VIEW} SELECT topic AS key, count(*) AS documents, {interval()} FROM scored WHERE topic <> '' GROUP BY 1 HAVING count(*) >= 20",
    "breakdown_time": f"{VIEW}, {YEARS} SELECT CAST(y AS INT) AS year, coalesce(documents, 0) AS documents, round(mean, 4) AS mean, round(low, 4) AS low, round(high, 4) AS high FROM (SELECT unnest(range(2015, least((SELECT max(year) FROM yr), 2026) + 1)) AS y) LEFT JOIN yr ON yr.year = y",
    "topics_list": f"{DS}, v AS ({ALL}) SELECT topic, count(*) AS documents FROM v WHERE topic <> '' GROUP BY 1 HAVING count(*) >= 100",
    "examples_by_band": f"{VIEW} {_EXAMPLE.format('', 'documents DESC', 6)} UNION ALL {_EXAMPLE.format('LIKELY_AI', 'mean DESC', 2)} UNION ALL {_EXAMPLE.format('LIKELY_HUMAN', 'mean', 2)} UNION ALL {_EXAMPLE.format('UNCERTAIN', 'documents DESC', 100)}",
    "ai_common": f"""{VIEW}, best AS (SELECT id, {LOW.format("(title || chr(10) || substr(text, 1, 6000))")} AS low FROM scored WHERE band = 'LIKELY_AI' ORDER BY round(p_ai, 6) DESC, id LIMIT 220),
bw AS (SELECT id, low, regexp_extract_all(low, '[a-z0-9'']+') AS w FROM best),
pr AS (SELECT id, w, list_transform(w, lambda x: CASE WHEN length(x) >= 3 AND x NOT IN ({_FILL}) THEN 1 ELSE 0 END) AS p FROM bw),
k AS (SELECT id, 'stock' AS kind, unnest(list_filter({_LIST(p.replace(chr(39), chr(39) * 2) for p in STOCK_PHRASES)}, lambda s: contains(low, s))) AS key FROM bw
  UNION ALL SELECT id, 'word', unnest(list_distinct(list_filter(w, lambda x: length(x) >= 3 AND x NOT IN ({_FILL})))) FROM bw
  UNION ALL SELECT DISTINCT id, 'phrase', unnest(list_concat(
    list_transform(list_filter(range(1, len(w)), lambda i: length(w[i]) >= 3 AND length(w[i + 1]) >= 3 AND p[i] + p[i + 1] >= 1), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(list_filter(range(1, len(w) - 1), lambda i: p[i] + p[i + 1] + p[i + 2] >= 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) FROM pr),
df AS (SELECT kind, key, count(*) AS documents FROM k GROUP BY ALL HAVING count(*) >= CASE kind WHEN 'stock' THEN 2 WHEN 'word' THEN greatest(3, (SELECT count(*) FROM best) * 8 // 100) ELSE greatest(3, (SELECT count(*) FROM best) * 6 // 100) END)
SELECT kind, key, documents, CAST(row_number() OVER (PARTITION BY kind ORDER BY documents DESC, key) AS INT) AS place FROM df QUALIFY row_number() OVER (PARTITION BY kind ORDER BY documents DESC, key) <= CASE kind WHEN 'stock' THEN 4 WHEN 'word' THEN 6 ELSE 5 END""",
    "strongest_signal": f"{VIEW}, s AS (SELECT unnest(['embedding_anomaly', 'stock_phrases', 'ngrams', 'stylometry', 'uniformity', 'stylometry_deviation']) AS key, unnest([{', '.join(third(f'avg({SIGNALS[k]})') for k in ('embedding_anomaly', 'stock_phrases', 'ngrams', 'stylometry', 'uniformity', 'stylometry_deviation'))}]) AS score, unnest([1, 2, 3, 4, 5, 6]) AS i FROM scored) SELECT key, score FROM s ORDER BY score DESC, i LIMIT 1",
    "strongest_detector": f"{VIEW}, s AS (SELECT unnest(['stylometry', 'stock', 'ngram', 'anomaly', 'deviation']) AS key, unnest([{', '.join(third(f'avg({SIGNALS[k]})') for k in ('stylometry', 'stock_phrases', 'ngrams', 'embedding_anomaly', 'stylometry_deviation'))}]) AS score, unnest([1, 2, 3, 4, 5]) AS i FROM scored) SELECT key, score FROM s ORDER BY score DESC, i LIMIT 1",
    "evidence_ranked": f"{STORED}, e AS (SELECT id, band, round(" + " + ".join(f"CASE WHEN contains({LOW.format(chr(40) + 'title || chr(32) || topic || chr(32) || ' + chr(39) + 'http://site' + chr(39) + ' || id % 7 || ' + chr(39) + '.example/' + chr(39) + ' || chr(32) || source' + chr(41))}, '{w}') THEN 4.0 ELSE 0.0 END" for w in ("which", "src7", "pages", "about", "india", "site3")) + " + abs(p_ai - 0.5) * 2 + CASE WHEN band = 'LIKELY_AI' THEN 0.5 ELSE 0.0 END, 6) AS s FROM scored) SELECT id, round(s, 4) AS score, band FROM e ORDER BY s DESC, id LIMIT 8",
    "excerpts": rf"""{DS}, h AS (SELECT id, substr(text, 1, 400) AS h FROM c), f AS (SELECT id, h, list_min(list_filter(list_transform(['does', 'note', 'the', 'patient', 'quantum'], lambda w: instr({LOW.format('h')}, w)), lambda x: x > 0)) AS f FROM h),
s AS (SELECT id, h, greatest(coalesce(f, 1) - 81, 0) AS s FROM f), p AS (SELECT id, h, s, CASE WHEN s > 0 THEN '…' ELSE '' END || regexp_replace(substr(h, s + 1, 100), '^{SPACE}+|{SPACE}+$', '', 'g') AS p FROM s)
SELECT id, CASE WHEN s + length(p) < length(h) THEN p || '…' ELSE p END AS excerpt FROM p""",
    "era_sample": f"{DS}, {DATED}, t AS (SELECT {TOPIC} AS topic, id, date FROM rec), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY date, id) - 1 AS r, count(*) OVER (PARTITION BY topic) AS n FROM t WHERE topic <> '') SELECT topic, id FROM r WHERE n <= 50 OR r IN (SELECT i * (n - 1) // 49 FROM range(50) x(i))",
    "year_rise": f"{VIEW}, {YEARS}, b AS (SELECT year, mean, (SELECT count(*) FROM yr q WHERE q.year < yr.year) AS k, (SELECT max(mean) FROM yr q WHERE q.year < yr.year) AS mx, (SELECT quantile_cont(mean, 0.5) FROM yr q WHERE q.year < yr.year) AS md FROM yr), f AS (SELECT min(year) AS rise_year FROM b WHERE mean >= 0.4 AND k > 0 AND (mx < 0.3 OR md < 0.3)) SELECT rise_year, (SELECT min(mean) FROM yr WHERE year > rise_year AND mean >= 0.55) AS late_low, (SELECT max(mean) FROM yr WHERE year > rise_year AND mean >= 0.55) AS late_high FROM f",
    "corpus_lines": f"""{VIEW}, b AS (SELECT {COLLECTION} AS collection, topic, {SUBJECT} AS subject, {TEXT_SUBJECT} AS text_subject FROM scored), k AS (SELECT 'collection' AS line, collection AS key, contains(lower(collection), 'wiki') AS w FROM b UNION ALL SELECT 'subject', subject, false FROM b UNION ALL SELECT 'text_subject', text_subject, false FROM b UNION ALL SELECT 'country', topic, contains(lower(collection), 'wiki') FROM b),
g AS (SELECT line, key, count(*) AS documents, count(*) FILTER (w) AS w FROM k WHERE key <> '' GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY line ORDER BY documents DESC, key) AS INT) AS place FROM g)
SELECT line, key, documents, place FROM r WHERE line <> 'subject' OR place <= 3 UNION ALL SELECT 'thin', key, documents, place FROM r WHERE line = 'subject' AND place > 3 AND key IN {THIN_SUBJECTS} UNION ALL SELECT 'news_only', key, documents, place FROM r WHERE line = 'country' AND w = 0""",
    "calculations": f"""{VIEW}, {YEARS}{edges('scored')}, s AS ({SUMMARY}), y AS (SELECT year, documents, {percent('mean')} AS p FROM yr WHERE year <= 2026)
SELECT (SELECT count(*) FROM corpus0) AS corpus, documents, likely_ai + likely_human + uncertain AS scored, documents - (likely_ai + likely_human + uncertain) AS pending, likely_ai, likely_human, uncertain, words, estimate, estimate_low, estimate_high,
(SELECT {percent('round(sum(p_ai * word_count) / sum(word_count), 6)')} FROM scored) AS word_percent, (SELECT {third('round(avg(p_ai), 6)')} FROM scored) AS mean_p, CAST(0.58 AS DOUBLE) AS ai_from, CAST(0.42 AS DOUBLE) AS human_to, CAST(0.5 AS DOUBLE) AS widest, (SELECT CAST(max(year) - 2014 AS BIGINT) FROM y) AS bins, (SELECT count(*) FROM y) AS bins_with_mean,
(SELECT CAST(min(year) AS INT) FROM y) AS first_year, (SELECT CAST(max(year) AS INT) FROM y) AS last_year, (SELECT p FROM y ORDER BY year DESC LIMIT 1) AS last_percent, (SELECT documents FROM y ORDER BY year DESC LIMIT 1) AS last_documents,
(SELECT CAST(year AS INT) FROM y ORDER BY p DESC, year LIMIT 1) AS peak_year, (SELECT max(p) FROM y) AS peak_percent, (SELECT count(*) FROM scored) AS nodes, (SELECT count(*) FROM de) AS edges FROM s""",
    "year_ranges": f"{VIEW} SELECT CAST(year AS INT) AS year, count(*) AS documents, {percent('avg(p_ai)')} AS mean, {percent('min(p_ai)')} AS low, {percent('max(p_ai)')} AS high FROM scored WHERE year > 0 GROUP BY 1",
    "era_cohort_pools": f"{DS.replace('SELECT * FROM corpus0', f'SELECT * EXCLUDE (topic), {CANONICAL} AS topic FROM corpus0 WHERE dataset_id = 1')}, {DATED}, {POOLS.format(src='rec')} SELECT *, least(before_pool, after_pool) >= 50 AS ready FROM pools",
    "era_articles": f"{WIKI} SELECT id, title, CAST(nullif(year, 0) AS INT) AS year, nullif(date, '') AS date, CASE WHEN date = '' THEN '' WHEN date = created_at THEN 'createdAt' ELSE 'publishedAt' END AS date_source, {third('p_ai')} AS p_ai, band FROM scored",
    "document_cards": f"{STORED} SELECT id, title, CAST(NULL AS VARCHAR) AS url, source, topic, nullif(subtopic, '') AS subtopic, nullif(published_at, '') AS published_at, nullif(created_at, '') AS created_at, CAST(word_count AS INT) AS word_count, {third('p_ai')} AS p_ai, {third('ci_low')} AS ci_low, {third('ci_high')} AS ci_high, band, round(detector_stylometry, 4) AS stylometry, {third('stock')} AS stock_phrase, round(detector_uniformity, 4) AS sentence_uniformity, round(detector_repetition, 4) AS ngram_repetition, round(anomaly, 4) AS embedding_anomaly, round(deviation, 4) AS stylometry_deviation, {third('recency')} AS post_chatgpt, substr(text, 1, 320) AS excerpt FROM scored",
    "url_odd_cases": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {n}, {h}, {str(pub).lower()}, {pa}, {co}, {ar})" for i, (n, h, pub, pa, co, ar) in enumerate(_ODD)) + ") t(k, normal, host, public, path, comparable, article)",
    "url_resolve": f"WITH {_HOSTED} " + " UNION ALL ".join(f"SELECT page_id, '{h}' AS href, {_TO.get(h, 'CAST(NULL AS VARCHAR)')} AS resolved FROM pd" for h in _HREFS),
    "url_coding": "SELECT doc_id, replace(replace(url_encode(t), '%20', '+'), '%7C', '|') AS encoded, t AS decoded FROM (SELECT doc_id, text AS t FROM documents)",
    "encyclopedia_urls": f"{DS}, t AS (SELECT id, title, replace(title, ' ', '_') AS d FROM c) " + " UNION ALL ".join(f"SELECT id, {u} AS url, {u if k == 'url' else k} AS canonical, {a} AS article, {str(f).lower()} AS follow, 'https://en.wikipedia.org/wiki/' || d AS own, title AS name FROM t" for u, k, a, f in _FORMS),
    "news_titles": f"WITH {_HOSTED}, s AS (SELECT page_id, substr(translate(regexp_extract(path, '([^/]*)$', 1), '-_', '  '), 1, 80) AS s, normal FROM pd) SELECT s.page_id, CASE WHEN s = '' THEN CASE WHEN s.page_id % 2 = 0 THEN 'src' ELSE pages.url END WHEN s.page_id % 2 = 0 THEN 'src: ' || s ELSE s END AS title FROM s JOIN pages USING (page_id)",
    "html_extract": f"SELECT page_id, trim({_TEXTED(chr(114) + 'egexp_extract(html, ' + chr(39) + '<title>([^<]*)</title>' + chr(39) + ', 1)')}) AS title, CAST(length({_TEXTED(_PLAIN_PAGE)}) AS INT) AS n_body, sha256({_TEXTED(_PLAIN_PAGE)}) AS body, CAST(len(regexp_extract_all(html, '<a href=\"[^\"]+\"')) AS INT) AS n_links FROM pages",
    "html_links": f"WITH {_HOSTED}, l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)) AS h, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1), 1) AS i FROM pages), f AS (SELECT l.page_id, origin || h AS link, min(i) AS i FROM l JOIN pd USING (page_id) WHERE starts_with(h, '/') AND origin || h <> normal GROUP BY ALL) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS place, link FROM f",
    "topic_rules": f"{CASES} SELECT id, canonical, label, general, country, CASE WHEN display IN ('India', 'United States', 'Germany', 'Australia') THEN display ELSE inferred END AS topic, pretty AS subtopic FROM tc3",
    "topic_normalize": f"{CASES} SELECT canonical AS topic, count(*) AS documents FROM tc3 GROUP BY 1",
    "text_helpers": f"""{DS}, z AS (SELECT id, title, text AS t, id % 50 / 37 AS x, id % 11 / 9 AS y FROM c), q AS (SELECT *, x / greatest(y, 1e-300) AS r, (x - y) / greatest(abs(y), 1e-300) AS rel FROM z)
SELECT id, substr(t, 1, list_max(list_filter(range(0, length(t) + 1), lambda k: strlen(substr(t, 1, k)) <= 50))) AS clipped, array_to_string(list_filter(list_transform(string_split(t, ','), lambda s: regexp_replace(s, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda s: s <> ''), '|') AS parts, true AS same, starts_with(lower(title), 'doc 1') AS starts, printf('%.1f', x) AS number,
CASE WHEN x < 1e-4 AND y < 1e-4 THEN 'about the same as' WHEN y < 1e-4 THEN 'much higher than' WHEN r >= 1.08 THEN printf('%.1f', r) || 'x as high as' WHEN r <= 0.92 THEN printf('%.0f', r * 100) || '% as high as' ELSE 'about the same as' END AS times,
CASE WHEN abs(y) < 1e-4 THEN CASE WHEN x > y + 0.02 THEN 'rose from near zero' ELSE 'barely moved' END WHEN rel >= 0.03 THEN 'rose ' || printf('%.0f', rel * 100) || '%' WHEN rel <= -0.03 THEN 'fell ' || printf('%.0f', -rel * 100) || '%' ELSE 'changed little' END AS change,
CASE WHEN y < 1e-4 THEN 'about the same as' ELSE '0% as high as' END AS times0, CASE WHEN x > 0.02 THEN 'rose from near zero' ELSE 'barely moved' END AS change0 FROM q""",
    "signals_text": f"{scored('dataset_id')} SELECT id, '{{\"post_chatgpt\":' || CAST({third('recency')} AS VARCHAR) || ',\"stylometry\":' || CAST({third('stylometry')} AS VARCHAR) || '}}' AS json, {third('recency')} AS recency, CAST(0.0 AS DOUBLE) AS none FROM scored",
    "date_forms": f"{DS}, z AS (SELECT id, DATE '2019-12-25' + CAST(id % 400 AS INT) AS d FROM c) SELECT id, CAST(d AS VARCHAR) AS date, strftime(d - 1, '%Y%m%d') || '235500' AS before, CASE WHEN id % 5 > 0 THEN CAST(d AS VARCHAR) END AS change, CAST(d AS VARCHAR) AS iso FROM z",
    "jsonl_ingest": f"{DS}, x AS (SELECT *, regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS t FROM c) SELECT title, CASE WHEN id % 2 = 0 AND topic <> '' THEN topic ELSE {GUESS} END AS topic, source, CAST(len(regexp_extract_all({LOW.format('text')}, '[a-z0-9'']+')) AS INT) AS word_count, '' AS url, sha256(t) AS text FROM x WHERE t <> ''",
    "news_ingest": "SELECT '2024-03-15' AS seen, 'src' AS source, url, '1#India' AS locations, 'x' AS codes FROM pages WHERE page_id % 3 = 0 AND starts_with(url, 'http')",
    "news_countries": f"WITH {_NEWS} SELECT array_to_string(ts, '|') AS countries, count(*) AS n FROM nt GROUP BY 1",
    "news_documents": f"""{("WITH " + _NEWS).replace("WITH ", "WITH RECURSIVE ", 1)}, o AS (SELECT *, row_number() OVER (ORDER BY url) AS r FROM nt WHERE len(ts) > 0),
cs AS (SELECT ['India', 'United States', 'Germany', 'Australia'] AS names),
g AS (SELECT 0::BIGINT AS r, [30, 30, 30, 30] AS places, '' AS topic UNION ALL
  SELECT r, CASE WHEN topic = '' THEN places ELSE list_transform(places, lambda x, i: x - CASE WHEN names[i] = topic THEN 1 ELSE 0 END) END, topic FROM (
    SELECT o.r, places, names, coalesce(list_filter(ts, lambda t: places[list_position(names, t)] > 0 AND places[list_position(names, t)] = list_max(list_transform(ts, lambda u: places[list_position(names, u)])))[1], '') AS topic
    FROM g JOIN o ON o.r = g.r + 1, cs)),
tt AS (SELECT url, source || ': ' || translate(regexp_extract(split_part(regexp_replace(url, '^https?://[^/]*', ''), '?', 1), '([^/]*)$', 1), '-_', '  ') AS title, source, topic FROM g JOIN o USING (r) WHERE topic <> '')
SELECT url, title, topic, '2024-03-15' AS seen, sha256('GDELT Project monitored news item titled "' || title || '". Seen on 2024-03-15. Published by ' || source || '. Source country ' || topic || '. Language English. Topic label ' || topic || '. Collected from the GDELT Project document API on api.gdeltproject.org. The GDELT Project monitors worldwide news coverage. Original article URL: ' || url || '.') AS text FROM tt""",
    "catalog_delete_cascade": f"{_STORE} SELECT ds.dataset_id, name, kind, count(c.id) AS documents, kind = 'WIKIPEDIA_SAMPLE' AS wikipedia, false AS gdelt, kind <> 'WIKIPEDIA_SAMPLE' AS deletable, 0 AS place FROM ds LEFT JOIN c USING (dataset_id) WHERE dataset_id = 1 GROUP BY ALL",
    "catalog_edge_cascade": f"{_STORE}, l AS (SELECT id FROM c WHERE dataset_id IN (1, 4)) SELECT dataset_id, src, dst FROM e WHERE dataset_id IN (1, 4) AND src IN (SELECT id FROM l) AND dst IN (SELECT id FROM l)",
    "catalog_clear": f"{_STORE} SELECT dataset_id, count(*) AS n, 'documents' AS what FROM c WHERE dataset_id <> 1 GROUP BY 1 UNION ALL SELECT dataset_id, count(*), 'edges' FROM e WHERE dataset_id <> 1 GROUP BY 1",
    "catalog_lookups": f"""{DS} SELECT 'name' AS asked, CAST(dataset_id AS BIGINT) AS id, name FROM ds WHERE lower(name) = 'wikipedia' UNION ALL SELECT 'kind', dataset_id, name FROM ds WHERE kind = 'GDELT'
UNION ALL SELECT 'id', dataset_id, name FROM ds WHERE dataset_id = 3 UNION ALL SELECT 'document', id, title FROM c WHERE id = 12 UNION ALL SELECT 'ids', id, title FROM c WHERE id BETWEEN 5 AND 8
UNION ALL SELECT 'edge', id + 1, 'embedding' FROM c WHERE id = 20 AND dataset_id = 1 AND id % 97 <> 5""",
    "catalog_counts": f"{DS} SELECT count(*) AS documents, count(*) FILTER (id % 9 = 0) AS unscored, CAST(3 AS BIGINT) AS datasets, false AS \"full\" FROM c",
    "stored_topics": f"{DS} SELECT dataset_id, topic, count(*) AS documents FROM c WHERE topic <> '' GROUP BY ALL",
    "short_doc_delete": f"{_STORE}, g AS (SELECT id FROM c WHERE dataset_id = 1 AND n < 900) SELECT (SELECT count(*) FROM c WHERE id NOT IN (SELECT id FROM g)) AS documents, (SELECT count(*) FROM e WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)) AS edges, (SELECT count(*) FROM g) AS deleted",
    "topic_updates": f"{DS} SELECT id, CASE WHEN id % 5 = 0 THEN 'new' ELSE topic END AS topic, CASE WHEN id % 4 = 1 AND coalesce(published_at, '') = '' THEN '2000-02-03' ELSE published_at END AS published_at FROM c",
    "created_backfill": f"{DS}, z AS (SELECT id, dataset_id, CASE WHEN dataset_id = 2 THEN '2016-05-05' ELSE created_at END AS d FROM c) SELECT id, CASE WHEN id % 6 > 0 AND (dataset_id = 2 OR coalesce(d, '') = '') THEN '2009-09-09' ELSE d END AS created_at FROM z",
    "catalog_merge": f"{DS}, n AS (SELECT id % 7 + 1 AS dataset_id, count(*) AS n FROM c GROUP BY 1), d AS (SELECT * FROM (VALUES (1, 'Wikipedia', 'WIKIPEDIA_SAMPLE'), (2, 'GDELT', 'GDELT'), (3, 'uploads', 'USER_UPLOAD'), (4, 'old subset', 'WIKIPEDIA_SUBSET'), (5, 'Wikipedia', 'WIKIPEDIA_SAMPLE'), (7, 'Site', 'USER_URLS')) t(dataset_id, name, kind)) SELECT d.*, CASE WHEN dataset_id = 7 THEN 0 ELSE coalesce(n, 0) END AS documents, CASE WHEN dataset_id = 7 THEN 0 ELSE coalesce(n, 0) END AS edges FROM d LEFT JOIN n USING (dataset_id)",
    "revision_backfill": f"{DS} SELECT id, CASE WHEN id % 3 > 0 THEN coalesce(created_at, '2011-01-01') ELSE created_at END AS created_at FROM c",
    "run_snapshot": f"WITH t AS (SELECT event_id % 6 AS run_id, {_STATE} AS s, value, event_id FROM events) SELECT run_id, count(*) AS total, count(*) FILTER (s IN ('complete', 'cached')) AS completed, count(*) FILTER (s = 'cached') AS cached, count(*) FILTER (s = 'running') AS running, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'ready') AS pending, round(100.0 * count(*) FILTER (s IN ('complete', 'cached')) / count(*), 6) AS progress, round(sum(value), 2) AS ms, CAST(sum(event_id * 3) AS BIGINT) AS bytes FROM t GROUP BY 1",
    "runs_interrupted": f"WITH t AS (SELECT {_STATE} AS s FROM events) SELECT CASE WHEN s IN ('running', 'ready') THEN 'failed' ELSE s END AS status, CASE WHEN s IN ('running', 'ready') THEN 'interrupted' ELSE '' END AS error, count(*) AS n FROM t GROUP BY ALL",
    "runs_latest": "SELECT event_id AS id, event_id % 4 AS dataset_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id DESC) = 1",
    "task_dependencies": "SELECT event_id AS id, CASE WHEN event_id = 0 THEN '[]' WHEN event_id - 1 = event_id // 2 THEN '[' || (event_id - 1) || ']' ELSE '[' || event_id // 2 || ', ' || (event_id - 1) || ']' END AS dependencies FROM events",
    "topics_distinct": f"{DS}, o AS (SELECT id, trim(CASE WHEN id % 2 = 0 THEN upper(topic) ELSE ' ' || topic END) AS topic FROM c) SELECT arg_min(topic, id) AS topic FROM o WHERE lower(topic) IN ('india', 'united states', 'germany', 'australia') GROUP BY lower(topic)",
    "titles_distinct": f"{DS}, o AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'doc ' ELSE 'DOC ' END || id // 3 AS title FROM c) SELECT id, title FROM o QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY id) = 1",
    "extract_longest": f"{DS} SELECT topic, id FROM c QUALIFY row_number() OVER (PARTITION BY topic ORDER BY strlen(text) DESC, id) = 1",
    "topic_caps": f"{DS} SELECT id, topic FROM c QUALIFY row_number() OVER (PARTITION BY topic ORDER BY id) <= CASE WHEN topic = 'Germany' THEN 60 ELSE 100 END",
    "topic_years": f"{DS}, z AS (SELECT dataset_id, topic, TRY_CAST(substr(coalesce(nullif(created_at, ''), published_at), 1, 4) AS INT) AS y FROM c) SELECT dataset_id, topic, count(*) AS documents, count(y) AS dated, min(y) AS first, max(y) AS last FROM z GROUP BY ALL",
    "article_extracts": f"{DS}, z AS (SELECT id, title, text FROM c WHERE id % 5 <> 0 AND regexp_replace(text, '{SPACE}', '', 'g') <> '') SELECT title, sha256(text) AS value FROM z UNION ALL SELECT lower(title), sha256(text) FROM z WHERE id % 2 = 0",
}

_ONE_LINE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_SHORT = r"CASE WHEN length({0}) <= {1} THEN {0} ELSE regexp_replace(substr({0}, 1, {2}), '\s+\S*$', '') || '…' END"
ORACLES |= {
    "page_lines": f"{scored('dataset_id')}, g AS (SELECT id, CASE id % 5 WHEN 0 THEN 'a example some page no ' || id || ' html' WHEN 1 THEN 'a slug of ' || id WHEN 2 THEN {_ONE_LINE.format('text')} ELSE title END AS g, {_ONE_LINE.format('text')} AS s, CASE WHEN id % 9 > 0 THEN CAST(CAST(floor(round(round(p_ai, 6) * 100, 9) + 0.5) AS BIGINT) AS VARCHAR) || '%' || CASE band WHEN 'LIKELY_AI' THEN ', likely AI-generated' WHEN 'LIKELY_HUMAN' THEN ', likely human-written' ELSE ', uncertain' END ELSE '' END AS label FROM scored) SELECT id, {_SHORT.format('g', 180, 176)} AS gist, {_SHORT.format('s', 110, 110)} AS sentence, label FROM g",
    "summary_json": f"{VIEW}, s AS ({SUMMARY}) SELECT '{{\"documents\":' || documents || ',\"scored\":' || scored || ',\"words\":' || words || ',\"likely_ai\":' || likely_ai || ',\"uncertain\":' || uncertain || ',\"likely_human\":' || likely_human || ',\"estimate\":' || estimate || ',\"topic\":null}}' AS json FROM s",
    "features_pending": f"{DS} SELECT dataset_id, count(*) AS documents, count(*) FILTER (id % 3 = 0 AND dataset_id <> 2) AS pending, CASE WHEN dataset_id = 2 THEN 'ready' ELSE 'pending' END AS state FROM c GROUP BY 1",
    "means_status": f"""{DS}, n AS (SELECT dataset_id, count(*) AS n FROM c WHERE dataset_id < 3 OR id = 9 GROUP BY 1)
SELECT dataset_id, CASE WHEN n >= 2 THEN 'EMBEDDED' ELSE 'NOT_TRAINED' END AS status, 'means' AS asked FROM ds LEFT JOIN n USING (dataset_id) UNION ALL SELECT dataset_id, 'VALIDATION_FAILED', 'training' FROM ds""",
    "edges_replace": f"{_STORE} SELECT dataset_id, 'embedding' AS reason, count(*) AS n, CAST(sum(dst) AS BIGINT) AS ends FROM e WHERE dataset_id <> 2 GROUP BY 1 UNION ALL SELECT 2, 'embedding+topic', count(*), CAST(sum(id + 10) AS BIGINT) FROM corpus0 WHERE dataset_id = 2",
}

#: Edges one by one, best first; the state is a list of the nodes' degrees.
ORACLES["graph_pruned"] = PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + """, un AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(cosine) AS c FROM edges GROUP BY 1, 2),
og AS (SELECT a, b, c, row_number() OVER (ORDER BY c DESC, a, b) AS r FROM un WHERE c >= 0.45 OR (SELECT count(*) FROM embeddings) <= 12),
lim AS (SELECT CASE WHEN count(*) > 20 THEN 2 ELSE 3 END AS cap, max(vec_id) AS m FROM embeddings),
g AS (SELECT 0::BIGINT AS r, list_transform(range(0, m + 1), lambda x: 0) AS deg, false AS ok FROM lim
  UNION ALL SELECT og.r, CASE WHEN deg[a + 1] < cap AND deg[b + 1] < cap THEN list_transform(deg, lambda x, i: x + CASE WHEN i IN (a + 1, b + 1) THEN 1 ELSE 0 END) ELSE deg END, deg[a + 1] < cap AND deg[b + 1] < cap
  FROM g JOIN og ON og.r = g.r + 1, lim)
SELECT a, b, round(c, 5) AS cosine FROM g JOIN og USING (r) WHERE ok"""
ORACLES["graph_increments"] = """WITH v AS (SELECT vec_id AS id, embedding, CASE WHEN vec_id % 50 = 7 THEN 0 ELSE label END AS t FROM embeddings WHERE vec_id % 10 <> 9),
p AS (SELECT a.id AS src, b.id AS dst, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS c, a.t = b.t AS st FROM v a JOIN v b ON a.id <> b.id)
SELECT src, dst, round(c, 5) AS cosine, st AS same_topic FROM p WHERE c >= 0.32 OR st QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(c + 0.08 * CAST(st AS INT), 9) DESC, dst) <= 8"""
ORACLES["stream_scores"] = ORACLES["era_scores"]

_BARE = r"regexp_replace({}, '^https?://(www\.)?', '')"
_LINKS = ORACLES["html_links"].rpartition(" SELECT page_id, CAST(row_number()")[0]
ORACLES["links_seen"] = f"""{_LINKS}, k AS (SELECT {_BARE.format("link")} AS key, link, page_id, page_id % 3 AS increment, i FROM f)
SELECT key, link, page_id, CAST(increment AS INT) AS increment FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY increment, page_id, i) = 1"""
ORACLES["crawl_frontier"] = f"""{_LINKS.replace("WITH ", "WITH RECURSIVE ", 1)}, e AS (SELECT {_BARE.format("normal")} AS a, {_BARE.format("link")} AS b FROM f JOIN nw USING (page_id)),
r AS (SELECT {_BARE.format("normal")} AS page, 0 AS depth FROM nw WHERE page_id % 25 = 0 UNION SELECT b, depth + 1 FROM r JOIN e ON a = page WHERE depth < 2)
SELECT page, CAST(min(depth) AS INT) AS depth FROM r GROUP BY page"""
ORACLES["site_links"] = """WITH r AS (SELECT page_id, CASE WHEN regexp_matches(x, '^[a-z]+$') THEN x ELSE 'none' END AS w FROM (SELECT page_id, regexp_extract(html, '<a href="/([^"]*)"', 1) AS x FROM pages)),
l AS (SELECT page_id, 'wiki' AS side, k, 'https://en.wikipedia.org/wiki/' || [w || '_x', 'Category:' || w, 'Portal:' || w || '_2'][k] AS link FROM r, range(1, 4) t(k)
  UNION ALL SELECT page_id, 'news', k, ['https://www.gdeltproject.org/' || w || '.html', 'https://blog.gdeltproject.org/' || w || '/a'][k] FROM r, range(1, 3) t(k))
SELECT page_id, side, CAST(k - 1 AS INT) AS place, link FROM l"""
