"""SQL counterparts for DuckDB of the operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# Windows of 10 words, or a shorter item whole, joined by a space; every document
# window of each such length is looked up.
_DECONTAMINATION = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
     windows AS (
         SELECT DISTINCT item, least(len(w), 10) AS n,
                array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
         FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
     docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     places AS (
         SELECT d.doc_id, s.n, i, array_to_string(w[i:i + s.n - 1], ' ') AS win
         FROM docs d, (SELECT DISTINCT n FROM windows) s, unnest(range(1, len(d.w) - s.n + 2)) AS t(i)),
     found AS (SELECT p.doc_id, p.i, p.n, w.item FROM places p JOIN windows w USING (n, win)),
     hit AS (
         SELECT doc_id, count(DISTINCT word) AS n_hit
         FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM (SELECT DISTINCT doc_id, i, n FROM found))
         GROUP BY doc_id),
     named AS (
         SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
         FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

_SUM = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"

_NEIGHBOURS = f"""
WITH vectors AS (
         SELECT vec_id, embedding AS v FROM embeddings
         WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     pairs AS (
         SELECT q.vec_id AS query_id, c.vec_id,
                {_SUM.format(a="q.v", b="c.v")} / sqrt({_SUM.format(a="q.v", b="q.v")} * {_SUM.format(a="c.v", b="c.v")}) AS score
         FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
     ranked AS (
         SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                vec_id, score
         FROM pairs)
SELECT * FROM ranked WHERE rank <= 5"""

# Base 32 of a digest: its hexadecimal digits as bits, five at a time.
_BITS = "array_to_string(list_transform(range(1, 41), lambda i: right(bin(CAST(concat('0x', hex[i]) AS INTEGER) + 16), 4)), '')"
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(0, 5), lambda j:
        CAST(bits[i * 5 + j + 1] AS INTEGER) * (16 >> j)))::BIGINT]), '')"""

_WARC = f"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
     bits AS (SELECT page_id, strlen(html) AS n, hex, {_BITS} AS bits FROM hashed),
     named AS (SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
                      min(page_id) OVER (PARTITION BY hex) AS first_id FROM bits)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM named"""


# The table is made in eight steps, each from the one before.
_CRC_TABLE = "s0 AS (SELECT b, b AS v FROM range(256) t(b))" + "".join(
    f", s{i + 1} AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM s{i})"
    for i in range(8)
)


def _network(number: str) -> str:
    """One pass of the 4-round network over ``number`` with domain side ``a``."""
    state = f"{{'l': ({number}) // a, 'r': ({number}) % a}}"
    return f"""list_reduce([{state}] || list_transform(range(1, 5), lambda i: {{'l': i, 'r': 0::BIGINT}}),
        lambda s, i: {{'l': s.r, 'r': (s.l + CAST(concat('0x', substr(md5(concat('20:', i.l, ':', s.r)), 1, 12)) AS BIGINT)) % a}})"""


_SHARDING = f"""
WITH RECURSIVE {_CRC_TABLE},
     crc_table AS (SELECT list(v ORDER BY b) AS entries FROM s8),
     bytes AS (
         SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS hex FROM documents),
     light AS (
         SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size,
                CAST(xor(4294967295, list_reduce(
                    [4294967295::BIGINT] || list_transform(range(0, strlen(text)), lambda i:
                        CAST(concat('0x', substr(hex, 2 * i + 1, 2)) AS BIGINT)),
                    lambda c, b: xor(entries[1 + xor(c, b) % 256], c // 256))) AS BIGINT) AS text_crc32
         FROM bytes, crc_table),
     numbered AS (
         SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS no,
                count(*) OVER () AS n, CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS a
         FROM light),
     walk AS (
         SELECT no, n, a, s.l * a + s.r AS place FROM (SELECT no, n, a, {_network('no')} AS s FROM numbered)
         UNION ALL
         SELECT no, n, a, s.l * a + s.r FROM (
             SELECT no, n, a, {_network('place')} AS s FROM walk WHERE place >= n))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place % 8 AS INTEGER) AS shard, place // 8 AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN walk USING (no) WHERE place < walk.n"""

# Phrases are their words joined by a space, which no word holds.
_COLLOCATIONS = r"""
WITH pieces AS (
         SELECT coalesce(lang, 'und') AS lang,
                unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[.,;:!?\x0A-\x0D]')) AS piece
         FROM documents),
     words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
     phrases AS (
         SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
         FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) t(k))
         GROUP BY ALL),
     sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM phrases WHERE k = 1 GROUP BY lang),
     often AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE k > 1 AND f >= 10),
     cuts AS (
         SELECT lang, k, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS tail
         FROM (SELECT *, unnest(range(1, k)) AS c FROM often)),
     scored AS (
         SELECT c.lang, c.k, c.phrase, c.a, c, x.f AS l, y.f AS r,
                (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
         FROM cuts c JOIN phrases x ON x.lang = c.lang AND x.phrase = head JOIN phrases y ON y.lang = c.lang AND y.phrase = tail),
     lowest AS (
         SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
     held AS (
         SELECT lang, part, max(a) AS longer
         FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM often WHERE k = 3)
         GROUP BY ALL),
     ranked AS (
         SELECT o.*, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank
         FROM lowest o LEFT JOIN held h ON h.lang = o.lang AND part = phrase
         WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000"""

ORACLE_SQL = {
    "op2_benchmark_decontamination": _DECONTAMINATION,
    "op3_nearest_vectors": _NEIGHBOURS,
    "op4_warc_in_zip": _WARC,
    "op8_feistel_sharding": _SHARDING,
    "op11_phrase_collocations": _COLLOCATIONS,
}
