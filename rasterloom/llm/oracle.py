"""DuckDB twins: of the scans, from the operators' own rules and templates; of near duplicates by all pairs that share a shingle; of the minimax cut; of clusters by every distance in every round; of spelling variants by words with a code point left out."""

from __future__ import annotations

from . import centroids, license_scan, near_dedup, secret_scan, sharding, spelling


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def secrets() -> str:
    """Pieces between matches give the places, as in the operator."""
    rules = ", ".join(f"({k}, {_literal(r.kind)}, {_literal(r.pattern.replace('(?<![0-9a-f])', '').replace('{32,}', '+'))}, {r.least}, {r.group})" for k, r in enumerate(secret_scan.RULES))
    one = "kind || ':' || start || ':' || (start + len)"
    return rf"""
    WITH rules(rank, kind, pat, least, grp) AS (VALUES {rules}), d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS (SELECT d.*, rules.*, string_split_regex(t, pat) AS p, regexp_extract_all(t, pat) AS m FROM d, rules WHERE regexp_matches(t, pat)),
    e AS (SELECT doc_id, rank, kind, pat, least, grp, p, m, unnest(m) AS x, generate_subscripts(m, 1) AS i FROM m),
    s AS (SELECT doc_id, rank, kind, length(x) AS len, (list_sum(list_transform(p[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0))::BIGINT AS start
          FROM e WHERE length(CASE WHEN grp = 2 THEN regexp_extract(x, pat, 2) ELSE x END) >= least),
    g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h, string_agg({one}, ',' ORDER BY start, rank) AS spans,
          string_agg({one}, ',' ORDER BY start, rank) FILTER (rank < {len(secret_scan.BASE)}) AS base FROM s GROUP BY doc_id)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


def licenses() -> str:
    """Whole phrases by full diagonals; notices by growing every chain of word pairs, hit by hit."""
    rows = [(label, True, text.split()) for text, label in license_scan.PHRASES.items()] + [(label, False, text.split()) for label, text in license_scan.NOTICES.items()]
    grams = ", ".join(f"({_literal(label)}, {str(whole).lower()}, {len(w) - 1}, {i}, {_literal(w[i])}, {_literal(w[i + 1])})" for label, whole, w in rows for i in range(len(w) - 1))
    return rf"""
    WITH RECURSIVE tpl(label, whole, grams, tpos, t1, t2) AS (VALUES {grams}),
    d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT doc_id, unnest(w[:-2]) AS a, unnest(w[2:]) AS b, unnest(range(len(w) - 1)) AS pos FROM d WHERE len(w) > 1),
    v AS (SELECT doc_id, label, whole, grams, pos - tpos AS diagonal, count(DISTINCT tpos) AS hits FROM p JOIN tpl ON a = t1 AND b = t2 GROUP BY ALL),
    n AS (SELECT doc_id, label, grams, pos, tpos, pos - tpos AS shift FROM p JOIN tpl ON a = t1 AND b = t2 WHERE NOT whole QUALIFY count(DISTINCT tpos) OVER (PARTITION BY doc_id, label) / grams >= {license_scan.COVERAGE}),
    c AS (SELECT *, 1 AS n FROM n UNION SELECT n.*, c.n + 1 FROM c JOIN n USING (doc_id, label) WHERE n.pos > c.pos AND n.tpos > c.tpos AND abs(n.shift - c.shift) <= {license_scan.SLACK}),
    f AS (SELECT doc_id, label, whole, diagonal AS start, 1.0::DOUBLE AS coverage FROM v WHERE whole AND hits = grams
          UNION ALL SELECT doc_id, label, false, NULL, (max(n) / max(grams))::DOUBLE FROM c GROUP BY doc_id, label HAVING max(n) / max(grams) >= {license_scan.COVERAGE}),
    g AS (SELECT doc_id, count(*) FILTER (whole) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM f GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN g USING (doc_id)"""


def near_duplicates() -> str:
    """All pairs with a common shingle, and what they reach."""
    k = near_dedup.WORDS
    return rf"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= {k} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i : i + {k - 1}], ' '))) END AS s FROM d),
    u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {near_dedup.THRESHOLD} * (any_value(a.n) + any_value(b.n) - count(*))),
    l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
    SELECT doc_id, len(any_value(s))::BIGINT AS n_shingles, min(r.b) AS component_id, doc_id = min(r.b) AS kept FROM s JOIN r ON r.a = s.doc_id GROUP BY doc_id"""


def shards(n: int) -> str:
    """The least capacity by halving, each time with a greedy walk over the groups' prefix sums. The CRC from its table, eight steps of one bit for each byte."""
    walk = lambda c: f"list_reduce(list_prepend(0::BIGINT, range({n})), lambda pos, k: list_max(list_filter(sums, lambda x: x <= pos + {c})))"
    return rf"""
    WITH RECURSIVE t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
    d AS (SELECT doc_id, md5(coalesce(text, '')) AS key, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
    g AS (SELECT key, sum(size)::BIGINT AS size FROM d GROUP BY key),
    o AS (SELECT key, (sum(size) OVER (ORDER BY key) - size)::BIGINT AS begin FROM g),
    p AS (SELECT list_prepend(0::BIGINT, list(b ORDER BY b)) AS sums, max(b) AS total FROM (SELECT (sum(size) OVER (ORDER BY key))::BIGINT AS b FROM g)),
    h AS (SELECT 1::BIGINT AS low, total AS high FROM p UNION ALL SELECT CASE WHEN fits THEN low ELSE mid + 1 END, CASE WHEN fits THEN mid ELSE high END FROM (SELECT low, high, (low + high) // 2 AS mid, {walk("(low + high) // 2")} = total AS fits FROM h, p WHERE low < high)),
    c AS (SELECT low AS room FROM h WHERE low = high),
    w AS (SELECT 1 AS k, 0::BIGINT AS pos UNION ALL SELECT k + 1, list_max(list_filter(sums, lambda x: x <= pos + room)) FROM w, p, c WHERE k < {n}),
    s AS (SELECT key, (SELECT count(*) FROM w WHERE k > 1 AND pos <= begin AND pos < total)::INT AS shard FROM o, p),
    b AS (SELECT least({sharding.MOST_BUCKETS}, (count(*) // {n * sharding.SLOT_ROWS} + 1) * 4) AS buckets FROM d)
    SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32, 'bytes' AS law, shard,
        row_number() OVER (PARTITION BY shard ORDER BY ('0x' || md5(doc_id::VARCHAR)[1:7])::BIGINT % buckets, doc_id, key) - 1 AS slot, NULL::INT AS grown_shard FROM d JOIN s USING (key), t, b"""


def clusters() -> str:
    """Each round as a table of all distances, and one of means."""
    n, k, rounds = centroids.DIMENSIONS, centroids.CENTROIDS, centroids.ROUNDS
    step = lambda i: rf"""
    a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, k := k)) AS m FROM q, c{i} GROUP BY r)"""  # noqa: E731
    move = lambda i: rf""",
    s{i} AS (SELECT m.k AS k, i, sum(v[i])::HUGEINT AS s, count(*) AS n FROM a{i} JOIN q USING (r), range(1, {n} + 1) t(i) GROUP BY ALL),
    c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{i} LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{i} GROUP BY k) USING (k)),"""  # noqa: E731
    return rf"""
    WITH q AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {n} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {n}),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id) NULLS LAST, v) - 1 AS k, v AS c FROM q QUALIFY k < {k}),{"".join(step(i) + move(i) for i in range(rounds))}{step(rounds)}
    SELECT vec_id, m.k::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM q JOIN a{rounds} USING (r) JOIN c{rounds} ON c{rounds}.k = m.k"""


def variants() -> str:
    """Two words are near if leaving out one place makes them equal, or makes one the other."""
    run = "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
    WITH RECURSIVE t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
    e AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '{spelling.PATTERN}')) AS x FROM documents),
    r AS (SELECT id, {run} AS run, count(*) AS n FROM e GROUP BY ALL),
    b AS (SELECT run, n, list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda z: ('0x' || z)::BIGINT) AS bytes FROM r),
    h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, z: xor(c >> 8, tab[(xor(c, z) & 255) + 1])), 4294967295) AS h FROM b, t),
    w AS (SELECT CASE WHEN h % {spelling.SLIP} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
    v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
    d AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM v)),
    p AS (SELECT a.word AS word, a.n AS n, b.word AS other, b.n AS m FROM d a JOIN d b USING (i, rest) WHERE a.word <> b.word
          UNION ALL SELECT DISTINCT d.word, d.n, v.word, v.n FROM d JOIN v ON rest = v.word UNION ALL SELECT DISTINCT v.word, v.n, d.word, d.n FROM d JOIN v ON rest = v.word),
    g AS (SELECT word, count(*) AS n_near, min((-m, other)) AS best FROM p GROUP BY word),
    f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= {spelling.RATIO} * n THEN best[2] END AS form, CASE WHEN -best[1] >= {spelling.RATIO} * n THEN -best[1] END AS form_n FROM v LEFT JOIN g USING (word)),
    c AS (SELECT word, word AS dest FROM f UNION ALL SELECT c.word, form FROM c JOIN f ON dest = f.word WHERE form IS NOT NULL)
    SELECT f.word, f.form, dest AS root, f.n, f.n_near, f.form_n FROM f JOIN c USING (word) JOIN f l ON l.word = dest WHERE l.form IS NULL"""
