"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabary.llm import centroids, chat, class_lm, licenses, line_chunks, mixing, near_dups, packing, quality, token_file, top_k, toxicity, whitening
from syllabary.llm.common import Scratch, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


@query("op1_token_file")
def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids to a token file, read it back, and give each document's place and checksum in it."""
    path = f"{Scratch(spark, 'token-file').path}/file"
    token_file.write(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_file.load(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _mixing_sql(weights=(5, 2, 1), share=1.5, repeats=2, block=128, shard=1 << 14, seed=17) -> str:
    """The mix of ``mixing`` in SQL, its eight rounds written out."""
    p, a, b = mixing.PRIME, mixing.STEP, mixing.TURN

    def draw(x: str, key: str) -> str:
        return f"(((({x}) % {p} * {a} + ({key})) % {p} * {b} + ({key}) * {a}) % {p})"

    rounds, last = [], "slots0"
    for i in range(mixing.ROUNDS):
        key = f"((place * 8191 + round * 131 + {seed + i}) % {p})"
        mate = f"((({draw(str(i + 1), key)} - x) % blocks + blocks) % blocks)"
        coin = f"({draw('greatest(x, mate)', key)} // 65536) % 2"
        rounds.append(
            f"slots{i + 1} AS (SELECT place, round, blocks, CASE WHEN {coin} = 1 THEN mate ELSE x END AS x FROM (SELECT *, {mate} AS mate FROM {last}))"
        )
        last = f"slots{i + 1}"
    return f"""
    WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+')) AS BIGINT) AS size FROM documents),
    per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sizes GROUP BY source),
    seated AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM per),
    weighed AS (SELECT *, CAST(list_extract([{', '.join(map(str, weights))}], CAST(place % {len(weights)} AS INTEGER) + 1) AS DOUBLE) AS weight,
                {float(repeats)}::DOUBLE * source_size AS cap FROM seated),
    levels AS (SELECT *, ({share}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
    aims AS (SELECT source, place, source_size, n_docs, least(cap, max(level) OVER () * weight) AS target,
             (source_size + {block - 1}) // {block} AS blocks FROM levels),
    sources AS (SELECT *, CASE WHEN source_size > 0 THEN target * blocks / source_size ELSE 0 END AS slots FROM aims),
    docs AS (SELECT d.doc_id, d.size, s.place, s.source_size, s.target,
             coalesce(sum(d.size) OVER (PARTITION BY s.place ORDER BY
               (((coalesce(d.doc_id, -1) % {p} + {p}) % {p}) * {a} % {p}) % (1 + s.n_docs // {mixing.BUCKET}), d.doc_id NULLS FIRST, d.size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
             FROM sizes d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
    parts AS (SELECT *, slots / shards AS part, slots / shards - floor(slots / shards) AS fraction FROM
              (SELECT *, greatest(ceil(sum(slots) OVER () / {shard}), 1)::BIGINT AS shards FROM sources WHERE slots > 0)),
    ends AS (SELECT *, sum(fraction) OVER (ORDER BY place) AS high, coalesce(sum(fraction) OVER (ORDER BY place
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, sum(fraction) OVER () AS whole FROM parts),
    spins AS (SELECT shard, {draw('shard * 7919 + i', str(seed))} / {float(p)}::DOUBLE * whole AS u
              FROM (SELECT DISTINCT shards, whole, round(whole)::BIGINT AS n FROM ends) e, unnest(range(shards)) AS t(shard), unnest(range(1, n + 1)) AS r(i)),
    counts AS (SELECT shard, e.place, e.blocks, floor(e.part)::BIGINT + (SELECT count(*) FROM spins s WHERE s.shard = t.shard AND s.u >= e.low AND s.u < e.high) AS n
               FROM ends e, unnest(range(e.shards)) AS t(shard)),
    numbered AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY place ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun FROM counts),
    slots0 AS (SELECT place, blocks, k // blocks AS round, k % blocks AS x FROM numbered, unnest(range(begun, begun + n)) AS t(k) WHERE k < {repeats} * blocks),
    {', '.join(rounds)},
    uses AS (SELECT place, x AS block, count(*) AS uses FROM {last} GROUP BY place, x),
    pieces AS (SELECT place, first, block, least(first + size, (block + 1) * {block}) - greatest(first, block * {block}) AS n
               FROM docs, unnest(range(first // {block}, (first + size - 1) // {block} + 1)) AS t(block) WHERE size > 0),
    taken AS (SELECT p.place, p.first, sum(p.n * u.uses) AS taken FROM pieces p JOIN uses u ON p.place = u.place AND p.block = u.block GROUP BY ALL)
    SELECT d.doc_id, d.size, d.source_size, d.target, coalesce(t.taken, 0)::BIGINT AS taken
    FROM docs d LEFT JOIN taken t ON d.place = t.place AND d.first = t.first AND d.size > 0
    """


@query("op9_mix_sources", _mixing_sql())
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: weights 5, 2, 1 in turn, 150% of all words, no source more than twice; words taken of each document."""
    return mixing.accounts(mixing.Mix(read(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, repeats=2))


@query(
    "op8_line_chunks",
    r"""
    WITH parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
    lines AS (SELECT doc_id, parts, i AS line, parts[i] AS body, ('0x' || substr(md5(parts[i]), 1, 8))::BIGINT AS h,
              len(regexp_extract_all(parts[i], '[^ \t\n\x0b\f\r]+')) AS words
              FROM parts, unnest(range(1, len(parts) + 1)) AS t(i)),
    ended AS (SELECT *, line = len(parts) OR words >= 50 OR coalesce(lead(words) OVER w, 0) >= 50
              OR ((h * 31 + coalesce(lag(h) OVER w, 0)) // 64) % 4 = 0 AS ends FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM ended),
    chunks AS (SELECT doc_id, chunk, min(line) AS start, max(line) AS stop, string_agg(body, chr(10) ORDER BY line) AS body,
               count(*) FILTER (WHERE words > 0) AS filled, count(*) AS n, max(words) AS most FROM numbered GROUP BY doc_id, chunk),
    fit AS (SELECT * FROM chunks WHERE filled >= 2 OR (n = 1 AND most >= 50)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, start) AS place FROM fit),
    gone AS (SELECT doc_id, i AS line FROM ranked, unnest(range(start, stop + 1)) AS t(i) WHERE place > 1)
    SELECT d.doc_id, CAST(count(g.line) AS BIGINT) AS n_removed, coalesce(string_agg(CAST(l.line - 1 AS VARCHAR), ',' ORDER BY l.line) FILTER (WHERE g.line IS NOT NULL), '') AS removed_lines,
    CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(l.body, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') END AS text
    FROM documents d LEFT JOIN lines l ON d.doc_id = l.doc_id LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY d.doc_id, d.text
    """,
)
def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the chunks of lines that an earlier place holds already, and which lines went."""
    kept = line_chunks.remove_repeats(read(spark, sf_dir, "documents"))
    lines = F.array_join(F.col("removed_lines").cast("array<string>"), ",")
    return kept.select("doc_id", F.size("removed_lines").cast("long").alias("n_removed"), lines.alias("removed_lines"), "text")


@query(
    "op8_line_runs",
    r"""
    WITH parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
    lines AS (SELECT doc_id, i AS line, parts[i] AS body, ('0x' || substr(md5(parts[i]), 1, 8))::BIGINT AS h,
              len(regexp_extract_all(parts[i], '[^ \t\n\x0b\f\r]+')) AS words
              FROM parts, unnest(range(1, len(parts) + 1)) AS t(i)),
    ended AS (SELECT *, lead(line) OVER w IS NULL OR words >= 50 OR coalesce(lead(words) OVER w, 0) >= 50
              OR ((h * 31 + coalesce(lag(h) OVER w, 0)) // 64) % 4 = 0 AS ends, sum(words) OVER w AS upto FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM ended),
    chunks AS (SELECT doc_id, min(line) AS start, max(line) AS stop FROM numbered GROUP BY doc_id, chunk
               HAVING count(*) FILTER (WHERE words > 0) >= 2 OR (count(*) = 1 AND max(words) >= 50)),
    runs AS (SELECT a.doc_id, a.line AS start, b.line AS stop FROM ended a JOIN ended b ON a.doc_id = b.doc_id AND a.line <= b.line
             WHERE b.upto - a.upto + a.words > 50 AND (b.upto - b.words - a.upto + a.words <= 50 OR b.upto - a.upto <= 50)),
    spans AS (SELECT * FROM chunks UNION SELECT * FROM runs),
    bodies AS (SELECT s.doc_id, start, stop, array_to_string(parts[start:stop], chr(10)) AS body FROM spans s JOIN parts p ON s.doc_id = p.doc_id),
    placed AS (SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(stop) OVER w AS first_stop FROM bodies WINDOW w AS (PARTITION BY body ORDER BY doc_id, start)),
    gone AS (SELECT DISTINCT doc_id, i AS line FROM placed, unnest(range(start, stop + 1)) AS t(i) WHERE doc_id <> first_doc OR start > first_stop)
    SELECT d.doc_id, CAST(count(g.line) AS BIGINT) AS n_removed, coalesce(string_agg(CAST(l.line - 1 AS VARCHAR), ',' ORDER BY l.line) FILTER (WHERE g.line IS NOT NULL), '') AS removed_lines,
    CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(l.body, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') END AS text
    FROM documents d LEFT JOIN lines l ON d.doc_id = l.doc_id LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY d.doc_id, d.text
    """,
)
def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the chunks, and without the runs of lines of over 50 words, that an earlier place holds already."""
    kept = line_chunks.remove_repeats(read(spark, sf_dir, "documents"), runs_over=50)
    lines = F.array_join(F.col("removed_lines").cast("array<string>"), ",")
    return kept.select("doc_id", F.size("removed_lines").cast("long").alias("n_removed"), lines.alias("removed_lines"), "text")


@query("op3_near_duplicates")
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component at a similarity of 0.85 on five-word shingles."""
    return near_dups.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


@query("op7_pack_sequences")
def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of 4096 ids; place, length and checksum of each piece."""
    pieces = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, sequence=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """The quality model of a folder: its labelled documents of quality 1 are the trusted target."""
    trusted = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("trusted")).filter("trusted is not null")
    return quality.learn(read(spark, sf_dir, "documents"), trusted)


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base rules and the verdict of the log-likelihood ratio for every document."""
    return quality.judge(read(spark, sf_dir, "documents"), quality_model(spark, sf_dir), ["doc_id"])


@query(
    "op6_top_k",
    """
    WITH fit AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
               FROM fit q JOIN fit c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
    """,
)
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows by integer inner product for every row whose id is divisible by 50."""
    return top_k.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op4_chat_format")
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation, and one that is made of control strings; digests of what is read back from the written text."""
    turns = chat.turn_rows(read(spark, sf_dir, "conversations"))
    hostile = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hostile), (-1, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string")
    written = Scratch(spark, "chat").keep(chat.format_conversations(turns.unionByName(extra)), "formatted")
    return chat.read_back(written)


@query(
    "op4_layouts",
    """
    WITH c AS (SELECT conv_id * 1048576 + turn AS id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, (conv_id + turn) % 5 AS kind FROM conversations)
    SELECT id AS conv_id, CASE WHEN kind = 2 THEN turn WHEN kind < 2 THEN 0 END::BIGINT AS turn, CASE WHEN kind < 3 THEN role END AS role, CASE WHEN kind < 3 THEN text END AS text,
    CASE kind WHEN 0 THEN 'messages' WHEN 1 THEN 'conversations' WHEN 2 THEN 'turn rows' END AS layout FROM c WHERE kind <> 3
    UNION ALL SELECT id, 0, 'user', text, 'prompt and response' FROM c WHERE kind = 3 AND text <> ''
    UNION ALL SELECT id, CASE WHEN text <> '' THEN 1 ELSE 0 END, 'assistant', 'yes', 'prompt and response' FROM c WHERE kind = 3
    """,
)
def op4_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a JSON record of one of five layouts, with more fields than the mappings name; each finds its mapping by its
    fingerprint and becomes canonical turns; the fifth layout has no mapping."""
    rows = read(spark, sf_dir, "conversations")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    other = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    layouts = (
        F.struct(F.array(F.struct(role.alias("role"), text.alias("content"), F.lit(1).alias("weight"))).alias("messages"), F.lit("x").alias("source")),
        F.struct(F.array(F.struct(other.alias("from"), text.alias("value"))).alias("conversations")),
        F.struct("conv_id", "turn", role.alias("role"), text.alias("text"), F.struct(F.lit(1).alias("a")).alias("meta")),
        F.struct(text.alias("prompt"), F.lit("yes").alias("response")),
        F.struct(text.alias("body"), F.array(F.lit(1)).alias("messages")),
    )
    kind, record = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)), F.lit(None).cast("string")
    for number, layout in enumerate(layouts):
        record = F.when(kind == number, F.to_json(layout)).otherwise(record)
    return chat.canonical_turns(rows.select((F.col("conv_id") * 1048576 + F.col("turn")).alias("conv_id"), record.alias("record")))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document by a model of the labelled rows outside the held-out third."""
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    labels = read(spark, sf_dir, "labels").filter(third != 1).select("doc_id", "toxic")
    docs = read(spark, sf_dir, "documents")
    scores = toxicity.score(docs, toxicity.learn(docs, labels))
    held_out = F.coalesce(third == 1, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def _licenses_sql() -> str:
    """The scan of ``licenses`` in SQL, with its known texts written out."""

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def canonical(column: str) -> str:
        out = f"regexp_replace(lower({column}), {text(licenses.COPYRIGHT)}, chr(10), 'g')"
        out = f"regexp_replace(' ' || regexp_replace({out}, {text(licenses.PUNCTUATION)}, ' ', 'g') || ' ', ' {{2,}}', ' ', 'g')"
        for spelling, one in licenses.SPELLINGS:
            out = f"replace({out}, ' {spelling} ', ' {one} ')"
        return f"trim({out})"

    known = ", ".join(f"({text(a)}, {text(b)})" for a, b in licenses.known_texts())
    return f"""
    WITH known AS (SELECT sha256(form) AS digest, min(license) AS license FROM
                   (SELECT license, {canonical('body')} AS form FROM (VALUES {known}) AS t(license, body)) WHERE form <> '' GROUP BY 1),
    whole AS (SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest FROM (SELECT doc_id, {canonical("coalesce(text, '')")} AS form FROM documents)),
    hits AS (SELECT l.doc_id, k.license FROM (SELECT doc_id, {canonical('line')} AS form FROM
             (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)) l JOIN known k ON l.form <> '' AND sha256(l.form) = k.digest),
    notices AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM hits GROUP BY doc_id)
    SELECT w.doc_id, w.digest, k.license, CAST(coalesce(n.n, 0) AS BIGINT) AS n_notices, coalesce(n.notices, '') AS notices
    FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN notices n ON w.doc_id = n.doc_id
    """


@query("op2_license_scan", _licenses_sql())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look every document, and every line of it, up among the known licence texts and notices."""
    return licenses.scan(read(spark, sf_dir, "documents"))


def _blocks_sql() -> str:
    """``licenses.scan_blocks`` in SQL; the canonical forms of the known texts and of the blocks are one expression."""

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    form = f"regexp_replace(lower(body), {text(licenses.COPYRIGHT)}, chr(10), 'g')"
    form = f"regexp_replace(' ' || regexp_replace({form}, {text(licenses.PUNCTUATION)}, ' ', 'g') || ' ', ' {{2,}}', ' ', 'g')"
    for spelling, one in licenses.SPELLINGS:
        form = f"replace({form}, ' {spelling} ', ' {one} ')"
    known = ", ".join(f"({text(a)}, {text(b)})" for a, b in licenses.known_texts())
    return f"""
    WITH known AS (SELECT form, min(license) AS license FROM (SELECT license, trim({form}) AS form FROM (VALUES {known}) AS t(license, body)) WHERE form <> '' GROUP BY 1),
    blocks AS (SELECT doc_id, trim({form}) AS form FROM (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), {text(licenses.BLANK_LINE)})) AS body FROM documents)),
    hits AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM blocks JOIN known USING (form) GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_blocks, coalesce(licenses, '') AS licenses FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id
    """


@query("op2_license_blocks", _blocks_sql())
def op2_license_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look every block between blank lines up among the known licence texts and notices, so that wrapped ones are found."""
    return licenses.scan_blocks(read(spark, sf_dir, "documents"))


@query("op11_class_lm")
def op11_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document by a class-based model of those outside the held-out seventh, beside add-one counts of words."""
    seventh = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return class_lm.score(read(spark, sf_dir, "documents"), seventh == 2)


def _centroids_sql(k=16, rounds=3, width=64, scale=64) -> str:
    """The clustering of ``centroids`` in SQL, its rounds written out; all numbers stay small enough to be exact."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
    norms{i} AS (SELECT number, list_transform(c, lambda x: x::DOUBLE) AS c, list_inner_product(list_transform(c, lambda x: x::DOUBLE), list_transform(c, lambda x: x::DOUBLE)) AS norm FROM centroids{i}),
    near{i} AS (SELECT r, vec_id, v, min((CAST(list_inner_product(d, d) - 2 * list_inner_product(d, c) + norm AS BIGINT), number)) AS best FROM kept, norms{i} GROUP BY r, vec_id, v, d)""")
        if i < rounds:
            steps.append(f"""
    sums{i} AS (SELECT number, place, floor(sum(x) / count(*))::BIGINT AS x FROM (SELECT best[2] AS number, unnest(v) AS x, unnest(range({width})) AS place FROM near{i}) GROUP BY number, place),
    means{i} AS (SELECT number, list(x ORDER BY place) AS c FROM sums{i} GROUP BY number),
    centroids{i + 1} AS (SELECT number, coalesce(m.c, o.c) AS c FROM centroids{i} o LEFT JOIN means{i} m USING (number))""")
    return f"""
    WITH kept AS (SELECT row_number() OVER () AS r, vec_id, v, list_transform(v, lambda x: x::DOUBLE) AS d FROM (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
                  WHERE embedding IS NOT NULL AND len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
    centroids0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS number, v AS c FROM kept QUALIFY number < {k}),{','.join(steps)},
    found AS (SELECT vec_id, best[2] AS number, best[1] AS distance FROM near{rounds})
    SELECT vec_id, number::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY number)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
    sha256(array_to_string(c, ',')) AS centroid_sha256 FROM found JOIN centroids{rounds} USING (number)
    """


@query("op12_centroids", _centroids_sql())
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of 16 centroids over all vectors of 64 components, with the final assignment."""
    return centroids.cluster(read(spark, sf_dir, "embeddings"), k=16, rounds=3, width=64, scale=64)


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every vector, and how far their covariance is from the identity."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"), most=4, scale=256)
