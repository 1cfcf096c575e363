"""The registered queries of the dealt operators and the SQL that they must agree with, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    alignment, ann, bpe, common, exact_dedup, fingerprint, jaccard, langid, license_scan, line_dedup, packing, phrases, quality, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and their decoding for every whole text, as digests."""
    coded = bpe.round_trip(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op5_sum_of_squares_packing")
def op5_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place, ids as their CRC-32."""
    pieces = packing.pack(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op8_exact_dedup", """
    WITH plain AS (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS text FROM documents
    )
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = min(doc_id) OVER same AS kept, sha256(text) AS text_sha256
    FROM plain WINDOW same AS (PARTITION BY text)
""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document, dropped ones too."""
    groups = exact_dedup.groups_of(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op6_warc_archive", """
    WITH body AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, coalesce(html, '') AS html FROM pages
    ), named AS (
        SELECT page_id, payload_bytes, html, sha1(encode(html)) AS hex,
               min(page_id) OVER (PARTITION BY html) AS first_id
        FROM body
    )
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda k:
               substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
                   (CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM named
""")
def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as an archive, then put every record together again: one row per record."""
    folder = common.Scratch(spark, "warc").root
    warc.write_archive(common.table(spark, sf_dir, "pages", "page_id", "url", "html"), folder)
    return warc.reconstruct(spark, folder).select(
        "page_id", F.col("n").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def _license_sql() -> str:
    """Brute force: every block against every template."""
    rows = ", ".join(f"('{label}', {license_scan._distinct(phrase)})" for label, phrase in license_scan.TEMPLATES)
    phrases = ", ".join(f"({phrase.split()}, '{label}')" for phrase, label in license_scan.PHRASES.items())
    size, step = license_scan.BLOCK, license_scan.BLOCK // 2
    return f"""
    WITH templates(label, t) AS (VALUES {rows}), phrases(p, label) AS (VALUES {phrases}),
    cut AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
    ), places AS (
        SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS i FROM cut, phrases
    ), base AS (
        SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, list(DISTINCT label) AS l FROM places GROUP BY doc_id
    ), blocks AS (
        SELECT doc_id, unnest(list_transform(range(1 + greatest(0, CAST(ceil((len(w) - {size}) / {step}.0) AS BIGINT))),
                                             lambda k: w[k * {step} + 1 : k * {step} + {size}])) AS b FROM cut
    ), hits AS (
        SELECT doc_id, label, len(list_intersect(t, b)) / len(t) AS c FROM blocks, templates
        WHERE len(list_intersect(t, b)) >= {license_scan.THRESHOLD} * len(t)
    ), more AS (SELECT doc_id, list(DISTINCT label) AS l, max(c) AS c FROM hits GROUP BY doc_id)
    SELECT cut.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word,
           coalesce(array_to_string(list_sort(base.l), ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(base.l, more.l))), ','), '') AS labels,
           CAST(CASE WHEN n > 0 THEN 1 ELSE coalesce(c, 0) END AS DOUBLE) AS score
    FROM cut LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
    """


@query("op9_license_scan", _license_sql())
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, labels and scores of every whole text."""
    return license_scan.scan(common.table(spark, sf_dir, "documents", "doc_id", "text")).drop("blocks")


@query("op10_line_dedup", """
    WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
    windows AS (
        SELECT doc_id, i, l[i + 1 : i + 3] AS w FROM (SELECT doc_id, l, unnest(range(len(l) - 2)) AS i FROM cut WHERE len(l) > 2)
    ), later AS (
        SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1
    ), gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM later) GROUP BY doc_id)
    SELECT doc_id,
           CASE WHEN g IS NULL THEN text
                ELSE array_to_string(list_transform(list_filter(range(len(l)), lambda i: NOT list_contains(g, i)), lambda i: l[i + 1]), chr(10)) END AS text,
           CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed
    FROM cut LEFT JOIN gone USING (doc_id)
""")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages."""
    return line_dedup.dedup_lines(common.table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")


#: A score below this is low quality.
QUALITY_LINE = 0.3


def learned_quality(documents: DataFrame, sf_dir: str) -> quality.Model:
    """The quality model of a folder: labels of held-out documents are not looked at."""
    labels = common.table(documents.sparkSession, sf_dir, "labels", "doc_id", "quality")
    return quality.fit(documents, labels.where(~common.held_out() & F.col("doc_id").isNotNull()))


@query("op4_quality_votes")
def op4_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every whole text."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    scored = quality.score(docs, learned_quality(docs, sf_dir))
    return scored.select(
        "doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_LINE).cast("int").alias("predicted"))


def learned_languages(documents: DataFrame) -> langid.Model:
    """The language model of a table: held-out documents are not looked at."""
    return langid.fit(documents.where(~common.held_out()))


@query("op7_language_centroids")
def op7_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    judged = langid.identify(docs.select("doc_id", "text"), learned_languages(docs))
    return judged.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score", "distance", "rejected")


@query("op2_parity_jaccard")
def op2_parity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with a similarity of 90 % on three-word shingles."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return jaccard.linked(docs, size=3, percent=90).select("doc_id", "n_shingles", "component_id")


@query("op3_learned_partitions")
def op3_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth id."""
    return ann.search(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


@query("op11_merge_path_alignment")
def op11_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the two tokenisers' ends for every whole text."""
    return alignment.align(common.table(spark, sf_dir, "documents", "doc_id", "text"))


def _fingerprint_sql() -> str:
    """Triplets as rows, buckets as groups. Texts are put in order by id alone: ids of the table are distinct."""
    buckets, quarter = 1 << fingerprint.BUCKET_BITS, (1 << fingerprint.BUCKET_BITS) // 4
    triplets = ", ".join(
        f"(b[i + {p + 1}] * 65536 + b[i + {q + 1}] * 256 + b[i + {r + 1}] + {kind << 24})" for kind, (p, q, r) in enumerate(fingerprint.PLACES))
    return f"""
    WITH numbered AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id DESC) AS no FROM documents),
    pairs AS (
        SELECT doc_id, t, coalesce(lead(doc_id) OVER (ORDER BY no), first_value(doc_id) OVER (ORDER BY no)) AS next_id,
               coalesce(lead(t) OVER (ORDER BY no), first_value(t) OVER (ORDER BY no)) AS u
        FROM numbered
    ), texts AS (
        SELECT doc_id, 0 AS k, t FROM pairs UNION ALL
        SELECT doc_id, 1, left(t, length(t) - length(t) // 3) || left(u, length(t) // 3) FROM pairs
    ), bytes AS (
        SELECT doc_id, k, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM texts
    ), places AS (SELECT doc_id, k, b, unnest(range(len(b))) AS i FROM bytes),
    triplets AS (
        SELECT doc_id, k, unnest([{triplets}]) AS x FROM places
    ), counted AS (
        SELECT doc_id, k, ((x * {fingerprint.MULTIPLIER}) & 4294967295) >> {32 - fingerprint.BUCKET_BITS} AS bucket, count(*) AS n
        FROM triplets WHERE x IS NOT NULL GROUP BY ALL
    ), filled AS (
        SELECT doc_id, k, bucket, coalesce(n, 0) AS n FROM (SELECT doc_id, k, unnest(range({buckets})) AS bucket FROM texts)
        LEFT JOIN counted USING (doc_id, k, bucket)
    ), quarters AS (
        SELECT doc_id, k, max(n) FILTER (WHERE p = {quarter}) AS q1, max(n) FILTER (WHERE p = {2 * quarter}) AS q2, max(n) FILTER (WHERE p = {3 * quarter}) AS q3
        FROM (SELECT doc_id, k, n, row_number() OVER (PARTITION BY doc_id, k ORDER BY n) AS p FROM filled) GROUP BY ALL
    ), codes AS (
        SELECT doc_id, k, bucket, CAST(n > q1 AS INTEGER) + CAST(n > q2 AS INTEGER) + CAST(n > q3 AS INTEGER) AS c
        FROM filled JOIN quarters USING (doc_id, k)
    ), prints AS (
        SELECT doc_id, k, list(c ORDER BY bucket) AS codes FROM codes GROUP BY ALL
    ), halves AS (
        SELECT doc_id, k, string_agg(substr('0123456789abcdef', 4 * c + d + 1, 1), '' ORDER BY bucket) AS body
        FROM (SELECT doc_id, k, bucket, c, lead(c) OVER (PARTITION BY doc_id, k ORDER BY bucket) AS d FROM codes) WHERE bucket % 2 = 0
        GROUP BY ALL
    ), lengths AS (
        SELECT doc_id, k, CASE WHEN n = 0 THEN 0 ELSE {fingerprint.LENGTH_STEPS} * o + ((n * {fingerprint.LENGTH_STEPS}) >> o) END AS length
        FROM (SELECT doc_id, k, len(b) AS n, CAST(floor(log2(greatest(len(b), 1))) AS INTEGER) AS o FROM bytes)
    ), whole AS (
        SELECT doc_id, k, p.codes, length, lower(lpad(to_hex(CAST(length AS BIGINT)), 4, '0')) || h.body AS print
        FROM prints p JOIN halves h USING (doc_id, k) JOIN lengths USING (doc_id, k)
    ), near AS (
        SELECT p.doc_id, p.t, p.u, o.print AS print, e.print AS edited_print,
               {_apart("o", "e")} AS edited_apart, {_apart("o", "x")} AS next_apart
        FROM pairs p JOIN whole o ON o.doc_id = p.doc_id AND o.k = 0 JOIN whole e ON e.doc_id = p.doc_id AND e.k = 1
        JOIN whole x ON x.doc_id = p.next_id AND x.k = 0
    )
    SELECT doc_id, length(t) AS n_chars, sha256(encode(left(t, length(t) - length(t) // 3) || left(u, length(t) // 3))) AS edited_sha256,
           print AS fingerprint, edited_print AS edited_fingerprint,
           CAST({fingerprint.RANGE} - least(edited_apart, {fingerprint.RANGE}) AS DOUBLE) / {fingerprint.RANGE} AS near_edited,
           CAST({fingerprint.RANGE} - least(next_apart, {fingerprint.RANGE}) AS DOUBLE) / {fingerprint.RANGE} AS near_next
    FROM near
    """


def _apart(one: str, other: str) -> str:
    codes = f"list_sum(list_transform(list_zip({one}.codes, {other}.codes), lambda z: abs(z[1] - z[2])))"
    return f"{fingerprint.CODE_WEIGHT} * {codes} + {fingerprint.LENGTH_WEIGHT} * least(abs({one}.length - {other}.length), {fingerprint.LENGTH_MOST})"


@query("op12_quartile_digest", _fingerprint_sql())
def op12_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every whole text, of its edited text, and how alike they are."""
    return fingerprint.with_next(common.table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op13_phrase_stripes", """
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ), cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    places AS (SELECT lang, w, unnest(range(len(w))) AS i FROM cut),
    grams AS (SELECT lang, w[i + 1 : i + m] AS g, m FROM places, (VALUES (1), (2), (3), (4)) v(m) WHERE i + m <= len(w)),
    f AS (SELECT lang, g, m, count(*) AS a FROM grams GROUP BY ALL),
    sizes AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
    found AS (SELECT lang, g, m, a FROM f WHERE m > 1 AND a >= 30),
    inside AS (
        SELECT lang, part, max(a) AS most FROM (
            SELECT lang, a, m, g, unnest(list_transform(list_filter(range(m * m), lambda z: z % m > 0 AND z % m < m - 1 AND z // m + z % m + 1 <= m),
                                                        lambda z: g[z // m + 1 : z // m + z % m + 1])) AS part
            FROM found WHERE m > 2
        ) GROUP BY lang, part
    ), cuts AS (SELECT lang, g, m, a, unnest(range(1, m)) AS k FROM found),
    scored AS (
        SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (x.a + y.a) AS BIGINT) AS score
        FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 : c.m]
    ), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
    kept AS (
        SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, l, r, score FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.part = b.g
        WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(b.a AS HUGEINT)
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000
""")
def op13_phrase_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of each language."""
    return phrases.ranked(phrases.collocations(common.table(spark, sf_dir, "documents", "lang", "text")), 2000)
