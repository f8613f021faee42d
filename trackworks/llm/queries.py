"""The operators over their whole tables, with production parameters, and the same as DuckDB SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackworks.llm import archive, chat, decontamination, divergence, embeddings, lines, near_duplicates, packing, phrases, quality, secrets, toxicity, url_filters

#: Where the public tokenizer files are; None takes the installed package's.
TOKENIZER_DIR: str | None = None

#: op6's rules.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: op6's block list, as the tables have none: addresses (host and path) of pages whose id this divides.
LISTED_PAGES = 7


def tokenizer_path(name: str) -> str:
    if TOKENIZER_DIR:
        return f"{TOKENIZER_DIR}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, out="c")
    hit = F.aggregate("c.spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return found.select(
        "doc_id", F.col("c.n_words").alias("n_words"), hit.alias("n_hit"), F.size("c.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("c.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) k, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i : i + least(10, len(w)) - 1], ' '))) win FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) win FROM d, ks WHERE len(w) >= k),
h AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
n AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) p FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item_id) n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) s FROM h GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_boilerplate(documents(spark, sf_dir).select("doc_id", "source", "text"), "source", removed="n_removed")


OP2_SQL = f"""WITH d AS (SELECT doc_id, source, text, coalesce(source, '') site, string_split(text, chr(10)) ls FROM documents),
n AS (SELECT site, count(*) pages FROM d GROUP BY 1),
k AS (SELECT site, l, count(*) c FROM (SELECT site, unnest(list_distinct(list_transform(coalesce(ls, ['']), lambda x: trim(x)))) l FROM d) WHERE l <> '' GROUP BY 1, 2),
bad AS (SELECT site, list(l) bl FROM k JOIN n USING (site) WHERE c > 1 AND c - 1 > {lines.MAX_SHARE} * (pages - 1) GROUP BY 1)
SELECT doc_id, source, CASE WHEN bl IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x: trim(x) = '' OR NOT list_contains(bl, trim(x))), chr(10)) END AS text,
  coalesce(CASE WHEN bl IS NULL THEN 0 ELSE len(list_filter(ls, lambda x: trim(x) <> '' AND list_contains(bl, trim(x)))) END, 0)::BIGINT AS n_removed
FROM d LEFT JOIN bad USING (site)"""


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = secrets.find_secrets(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, out="s")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), count("random"), F.sha2(joined(F.filter("s", lambda x: x["kind"] != "random")), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels), out="q")
    return scored.select("doc_id", F.col("q.score").alias("score"), F.col("q.text_view").alias("text_score"), F.col("q.meta_view").alias("meta_score"), (F.col("q.score") >= 0.5).alias("kept"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), percent=85)


_SHINGLE_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP5_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, {_SHINGLE_WORDS} w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) g FROM d),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id x, doc_id y FROM d UNION SELECT r.x, b.y FROM r JOIN both_ways b ON r.y = b.x),
c AS (SELECT x doc_id, min(y) component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)"""


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = url_filters.addresses(pages.filter(F.col("page_id") % LISTED_PAGES == 0))
    return url_filters.judge_urls(pages, URL_RULES, listed).drop("url")


OP6_SQL = f"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) path FROM pages),
rules(verdict, rule, rh, rp) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
j AS (SELECT p.page_id, p.host, p.path, arg_max(struct_pack(v := verdict, r := rule), len(rh) * 1000 + len(rp)) w FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1, 2, 3),
k AS (SELECT DISTINCT host || path a FROM p WHERE host || path <> '' AND page_id % {LISTED_PAGES} = 0)
SELECT p.page_id, p.host, p.path, w.r AS rule, coalesce(w.v, CASE WHEN p.host || p.path IN (SELECT a FROM k) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN j ON j.page_id = p.page_id AND j.host = p.host AND j.path = p.path"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0, payload="crc32")
    return packed.select("doc_id", "piece", "start", "length", F.col("crc32").alias("ids_crc32"), "sequence_id", "offset")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.98)


OP8_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id x, b.vec_id y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id x, vec_id y FROM embeddings UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x vec_id, min(y) component_id FROM r GROUP BY 1),
n AS (SELECT x vec_id, count(*) n_links FROM p GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, usable=~held_out), out="t")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("t.score").alias("score"), (F.col("t.score") >= 0.5).cast("int").alias("predicted"), F.size("t.spans").cast("long").alias("n_spans"))


#: What both turns of the conversation that tries the template say.
PROBE = "\\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    back = chat.read_back(chat.format_conversations(turns.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    targets = F.array_join("targets", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(targets).cast("long").alias("loss_chars"), F.sha2(targets, 256).alias("loss_sha256"), "formatted_chars")


_ESC = "({1}({0}) + length({0}) - length(replace(replace(replace({0}, chr(92), ''), '#', ''), '<', '')))"
_ROLE = "({1}({0}) + length({0}) - length(replace(replace(replace(replace({0}, chr(92), ''), '#', ''), '<', ''), ':', '')))"
_SIZE = f"4 + {_ROLE.format('role', '{0}')} + 2 + {_ESC.format('text', '{0}')} + {len(chat.TURN_END)}"

OP10_SQL = f"""WITH RECURSIVE t AS (SELECT conv_id, turn::BIGINT turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'),
u AS (SELECT *, (rank - 1) // {chat.CHUNK_TURNS} part FROM (SELECT *, coalesce(conv_id, -99) c, {_SIZE.format("strlen")} tokens, {_SIZE.format("length")} chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) rank FROM t)),
sys AS (SELECT c, tokens st, chars sc FROM u WHERE role = 'system' QUALIFY row_number() OVER (PARTITION BY c ORDER BY rank) = 1),
v AS (SELECT u.*, sc, CASE WHEN role = 'system' THEN 0 ELSE coalesce(st, 0) END beside, part pno FROM u LEFT JOIN sys ON sys.c = u.c),
b AS (SELECT *, lag(tokens, 1) OVER w t1, lag(role, 1) OVER w r1, lag(chars, 1) OVER w c1, lag(tokens, 2) OVER w t2, lag(role, 2) OVER w r2, lag(chars, 2) OVER w c2, lag(pno, 2) OVER w p2,
  least({chat.HISTORY_TOKENS}, {chat.BUDGET} - beside - tokens) room, sum(tokens) OVER (PARTITION BY c ORDER BY rank) upto, sum(chars) OVER (PARTITION BY c ORDER BY rank) chars_upto,
  sum((role = 'system')::INTEGER) OVER (PARTITION BY c ORDER BY rank) systems, max(rank) OVER (PARTITION BY c, part) last FROM v WINDOW w AS (PARTITION BY c ORDER BY rank)),
k AS (SELECT *, coalesce(r1 <> 'system' AND t1 <= room, false) ok1, coalesce(r1 <> 'system' AND t1 <= room AND r2 <> 'system' AND p2 >= pno - 1 AND t1 + t2 <= room, false) ok2 FROM b),
h AS (SELECT *, CASE WHEN ok2 THEN t1 + t2 WHEN ok1 THEN t1 ELSE 0 END ht, CASE WHEN ok2 THEN c1 + c2 WHEN ok1 THEN c1 ELSE 0 END hc FROM k),
nx AS (SELECT s.c, s.rank, coalesce(min(e.rank), any_value(s.last) + 1) nxt FROM h s LEFT JOIN h e ON e.c = s.c AND e.part = s.part AND e.rank > s.rank AND e.upto - s.upto + s.tokens > {chat.BUDGET} - s.beside - s.ht GROUP BY 1, 2),
r AS (SELECT c, min(rank) rank FROM u GROUP BY c, part UNION SELECT nx.c, nx.nxt FROM r JOIN nx ON nx.c = r.c AND nx.rank = r.rank JOIN u ON u.c = nx.c AND u.rank = nx.nxt),
f AS (SELECT r.c, sum(e.chars_upto - s.chars_upto + s.chars + s.hc + CASE WHEN s.sc IS NOT NULL AND e.systems - s.systems + (s.role = 'system')::INTEGER = 0 THEN s.sc ELSE 0 END) chars
  FROM r JOIN h s ON s.c = r.c AND s.rank = r.rank JOIN nx ON nx.c = r.c AND nx.rank = r.rank JOIN h e ON e.c = r.c AND e.rank = nx.nxt - 1 GROUP BY 1),
g AS (SELECT c, any_value(conv_id) conv_id, count(*) n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY rank) said, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY rank), '') loss FROM u GROUP BY 1)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, f.chars::BIGINT AS formatted_chars FROM g JOIN f USING (c)"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir).select("text", "lang"))


_FOLDED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""WITH d AS (SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array({_FOLDED.format("text")}, '[.,;:!?\x0A-\x0D]')) piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') w FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) phrase FROM p, (SELECT unnest([1, 2, 3, 4]) k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) c FROM g GROUP BY ALL),
n AS (SELECT lang, sum(c) n FROM f WHERE k = 1 GROUP BY 1),
a AS (SELECT lang, k, phrase, string_split(phrase, ' ') w, c a FROM f WHERE k >= 2 AND c >= 30),
cut AS (SELECT lang, phrase, w, a, unnest(range(1, k)) j FROM a),
s AS (SELECT cut.lang, cut.phrase, cut.a, j, l.c l, r.c r, 2000000::HUGEINT * cut.a // (l.c + r.c) score FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(w[1 : j], ' ')
  JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(w[j + 1 :], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (SELECT DISTINCT x.lang, x.phrase FROM a x JOIN a y ON x.lang = y.lang AND y.k > x.k AND 100 * y.a >= 80 * x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')),
o AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) rank FROM b ANTI JOIN held USING (lang, phrase))
SELECT o.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n::BIGINT AS n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000"""


def op12_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archived(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


OP12_SQL = f"""WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) n, sha256(coalesce(html, '')) d FROM pages),
m AS (SELECT *, n >= {archive.LEAST_REVISITED} AND page_id IS DISTINCT FROM min(page_id) OVER (PARTITION BY d) again, min(page_id) OVER (PARTITION BY d) least FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN least END AS refers_to, url FROM m"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, sf_dir).select("text", "lang", "source"))


OP13_SQL = f"""WITH d AS (SELECT row_number() OVER () i, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all({_FOLDED.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents),
t AS (SELECT i, lang, source, unnest(w) term FROM d),
c AS (SELECT lang, source, term, count(*) c, count(DISTINCT i) docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(c) c FROM c GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) v, sum(c) n FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT c.lang, c.source, sum(c.c) n FROM c JOIN k USING (lang, term) GROUP BY ALL),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 2) // (coalesce(n.n, 0) + 2 * v.v) p, 1 + 1000000000::HUGEINT * (k.c + 2) // (v.n + 2 * v.v) q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) value FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(x.value, 0) value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM m WHERE c > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 10"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_secrets": op3_secrets,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_chat_format": op10_chat_format,
    "op11_collocations": op11_collocations,
    "op12_warc_archive": op12_warc_archive,
    "op13_source_divergence": op13_source_divergence,
}
SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op5_minhash_near_dedup": OP5_SQL,
    "op6_url_filter": OP6_SQL,
    "op8_embedding_near_dedup": OP8_SQL,
    "op10_chat_format": OP10_SQL,
    "op11_collocations": OP11_SQL,
    "op12_warc_archive": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
