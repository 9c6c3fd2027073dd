"""The registered queries of the training-data operators, and their DuckDB equivalents."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import chat_format, embedding_dedup, gif_media, language_id, line_dedup, ngram_join, packing, quality_ranking, secret_scan, sentencepiece_dropout, stages, token_alignment, toxicity, whitening
from gaugeworks.llm.common import held_out, read_table, scratch, written


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text with merge-dropout 0.1, and whether they decode to it. Null and empty texts have no ids; repeated rows stay."""
    import public_tokenizers

    return sentencepiece_dropout.encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the rows that aren't held out. Null and letterless texts are `und` with score 0; repeated rows stay."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    passages = language_id.sample_passages(docs.where(~held_out(F.col("doc_id"), 4, 2)).select("text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), passages, reject=False)
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 4, 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans with one stored ledger: versions of an earlier scan, then all versions, of which only unseen blobs are scanned."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch(spark, "secret-ledger")
    secret_scan.extend_ledger(docs.where(F.xxhash64("text") < 0), path)
    ledger = secret_scan.extend_ledger(docs, path)
    found = secret_scan.findings_by_path(docs, ledger, ["doc_id"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    base = F.filter("findings", lambda f: f["kind"].isin("assign", "access", "hex"))  # rules that are added don't change this digest
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed("findings").alias("spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every whole text. A null or empty text is one empty line, which stays; rows of one id are one document."""
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every whole text, learned from the labels that aren't held out. Null, empty and clean texts get the rate of toxic ones among clean texts; repeated rows stay."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", "toxic")
    found = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 5, 0).alias("held_out"), "score", "predicted", "clauses", "worst")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors. Null, zero and non-finite vectors link with nothing; repeated rows of one id and vector are one vector."""
    return embedding_dedup.link_embeddings(read_table(spark, sf_dir, "embeddings"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 5-word shingles. Texts without words link with nothing; rows of one id are one document."""
    return ngram_join.ngram_components(read_table(spark, sf_dir, "documents"))


def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GIF files are written as a column of a table; what is returned is read back from there, frame by frame."""
    stored = gif_media.store_gifs(read_table(spark, sf_dir, "documents")).withColumn("file", F.monotonically_increasing_id())
    stored = written(stored, "gif-files")
    shared = ("doc_id", "n_bytes", "media_bytes", "media_sha256")
    files = stored.select("file", "gif", "doc_id", "n_bytes", F.octet_length("gif").cast("long").alias("media_bytes"), F.sha2("gif", 256).alias("media_sha256"))
    read = gif_media.file_digests(gif_media.decode_gifs(files, "file", "gif", keep=shared, rgb=False), keep=shared)
    feature = F.concat(F.format_string("%d frames, %d ms, colours ", "n_frames", "duration_ms"), F.array_join(F.col("histogram").cast("array<string>"), " "))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "n_frames", "duration_ms", "histogram")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renderings of all conversations. One may hold any share of the table, so dialogues are cut into parts of 512 turns. Null texts are empty, repeated rows stay."""
    rows = chat_format.rotate_perspectives(read_table(spark, sf_dir, "conversations"), turns_per_row=512)
    return rows.withColumn("masks", F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"])), ","))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every text in a window. A null or empty text is an end id alone; repeated rows are packed each."""
    import public_tokenizers

    pieces = packing.pack_documents(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op11_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every whole text, learned from the labels that aren't held out. Null and empty texts are scored by their features, all zero; repeated rows stay."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 3, 1)).select("doc_id", "quality")
    found = quality_ranking.score_documents(docs, quality_ranking.fit(docs, labels))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 3, 1).alias("held_out"), "score", "predicted", "strength")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of two tokenisers' tokens in every whole text, with their counts over the corpus. Null and empty texts have zeros; each row counts as a document, repeated ones too."""
    import public_tokenizers

    ranks, model, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
    first, second = functools.partial(token_alignment.byte_level, ranks, pattern), functools.partial(token_alignment.pieces, model)
    return token_alignment.link_scores(read_table(spark, sf_dir, "documents"), first, second)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four leading components of all vectors that can be whitened. Null, empty and non-finite vectors have no row; repeated rows have each their own."""
    found = whitening.whiten_embeddings(read_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error")


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_secret_scans": op3_secret_scans,
    "op4_toxicity": op4_toxicity,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_gif_media": op7_gif_media,
    "op8_line_dedup": op8_line_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_packing": op10_packing,
    "op11_quality_ranking": op11_quality_ranking,
    "op12_token_alignment": op12_token_alignment,
    "op13_whitening": op13_whitening,
    "pipeline": stages.run,
}

_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STRIP = "trim({0}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_LINE_KEY = _ASCII_LOWER.format(_STRIP.format("line"))

#: Of one kind: hits, the gaps before them, and a list of spans.
_KIND_SQL = """
    {kind} AS (
        SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, hits, gaps, vals FROM (
            SELECT doc_id, regexp_extract_all(body, '{rx}') AS hits, regexp_split_to_array(body, '{rx}') AS gaps,
                   regexp_extract_all(body, '{rx}', {group}) AS vals
            FROM d WHERE regexp_matches(body, '{rx}'))),
    {kind}_spans AS (
        SELECT doc_id, {rank} AS rank, '{kind}' AS kind,
               list_sum(list_transform(gaps[1:i], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0)::BIGINT AS s,
               length(hits[i]) AS n
        FROM {kind} WHERE length(vals[i]) >= {least})"""
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

_NAME_SQL = functools.reduce(lambda name, c: f"replace({name}, chr({ord(c)}), '%{ord(c):02X}')", chat_format.ESCAPED, "role")

ORACLE_SQL = {
    "op3_secret_scans": "WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),"
    + ",".join(
        _KIND_SQL.format(kind=kind, rx=rx, group=group, rank=rank, least=least)
        for rank, (kind, rx, group, least) in enumerate((("assign", _ASSIGN, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)))
    )
    + """,
    found AS (SELECT * FROM assign_spans UNION ALL SELECT * FROM access_spans UNION ALL SELECT * FROM hex_spans),
    per_doc AS (
        SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
               string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS spans
        FROM found GROUP BY doc_id)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
           sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents LEFT JOIN per_doc USING (doc_id)""",
    "op5_embedding_dedup": """
    WITH RECURSIVE v AS (
        SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    parts AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
    degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN parts ON parts.a = vec_id LEFT JOIN degrees ON degrees.a = vec_id""",
    "op6_ngram_join": f"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(regexp_split_to_array({_ASCII_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS s
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM words WHERE len(ws) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY a, b),
    links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
    SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id
    FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id""",
    "op8_line_dedup": f"""
    WITH lines AS (
        SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
    keyed AS (SELECT doc_id, line, pos, {_LINE_KEY} AS key FROM lines),
    common AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
    judged AS (SELECT k.doc_id, line, pos, first_doc IS NOT NULL AND k.doc_id > first_doc AS gone FROM keyed k LEFT JOIN common USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id""",
    "op9_chat_format": r"""
    WITH ranked AS (
        SELECT conv_id, role, replace(coalesce(text, ''), '<|', '<\|') AS body, coalesce(role = 'system', false) AS context,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, replace(coalesce(text, ''), '<|', '<\|')) - 1 AS n FROM conversations),
    t AS (
        SELECT *, n // 512 AS part, CASE WHEN context THEN '<|' || {name} || '|>' WHEN role IS NULL THEN '<|user|>' ELSE '<|user name=' || {name} || '|>' END || chr(10) AS named FROM ranked),
    openings AS (SELECT conv_id, min_by(named || body || '<|end|>' || chr(10), n) AS opening FROM t WHERE context GROUP BY conv_id),
    speakers AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
    said AS (
        SELECT t.conv_id, participant, part, n, body, CASE WHEN part > 0 THEN coalesce(opening, '') ELSE '' END AS opening, role IS NOT DISTINCT FROM participant AS own,
               CASE WHEN role IS NOT DISTINCT FROM participant THEN '<|assistant|>' || chr(10) ELSE named END AS head
        FROM t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN openings o ON t.conv_id IS NOT DISTINCT FROM o.conv_id),
    placed AS (
        SELECT *, length(head) + length(body) + 8 AS size,
               length(opening) + sum(length(head) + length(body) + 8) OVER (PARTITION BY conv_id, participant, part ORDER BY n ROWS UNBOUNDED PRECEDING) AS stop FROM said)
    SELECT *, coalesce(sum(length(text) - opening_chars) OVER (PARTITION BY conv_id, participant ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS text_start FROM (
    SELECT conv_id, participant, part, min(n) AS first_turn, count(*) AS n_turns, any_value(opening) || string_agg(head || body || '<|end|>' || chr(10), '' ORDER BY n) AS text,
           coalesce(string_agg((stop - size + length(head))::BIGINT || ':' || (stop - 1)::BIGINT, ',' ORDER BY stop) FILTER (own), '') AS masks,
           coalesce(sum(length(body) + 7) FILTER (own), 0)::BIGINT AS n_masked, length(any_value(opening)) AS opening_chars
    FROM placed GROUP BY conv_id, participant, part)""".replace("{name}", _NAME_SQL),
}
