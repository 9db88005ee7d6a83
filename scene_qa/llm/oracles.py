"""SQL of the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from scene_qa.llm import decontaminate, mixture, url_filter

_PATTERNS = ", ".join(f"('{r.name}', '{r.pattern}', {i}, {r.rank})" for i, r in enumerate(url_filter.PATTERNS))

_MASKS = [*decontaminate.MASKS, *("1" * n for n in range(1, 5))]  # short items have runs of up to four words
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-/:-`{-\\x7F]+')"
_AHEAD = ", ".join(f"lead(w0, {k}) OVER o AS w{k}" for k in range(1, max(map(len, _MASKS))))


def _seeds(of: str, key: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, p, n, '{m}' AS mask, concat_ws(' ', {', '.join(f'w{j}' for j, c in enumerate(m) if c == '1')}) AS seed FROM {of} WHERE w{len(m) - 1} IS NOT NULL" for m in _MASKS)


def _normal(text: str) -> str:
    return rf"translate(trim(regexp_replace({text}, '[ \t\n\r\x0b\x0c]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _mod(x: str, m: int = 1 << 64) -> str:
    return f"(({x}) % {m}::UHUGEINT)"


def _times(x: str, by: int) -> str:
    return _mod(f"({x})::UHUGEINT * {by}::UHUGEINT")


def _turn(x: str, by: int) -> str:
    """Rotation to the left: a power of two modulo 2^64 - 1."""
    return _mod(f"({x})::UHUGEINT * {1 << by}::UHUGEINT", (1 << 64) - 1)


_FINITE = "list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))"


def _codebooks(rounds: int) -> str:
    """Tables of Lloyd's rounds over x(id, p, v), v a list of integers: b0 to b<rounds> of entries, a0 to a<rounds> of assignments."""
    out = ["b0 AS (SELECT p, id AS e, v FROM x WHERE id < 64)"]
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT id, p, v, min(d * 64 + e) % 64 AS e, min(d) AS d FROM (
            SELECT x.id, x.p, any_value(x.v) AS v, b.e, sum((x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))::BIGINT AS d FROM x JOIN b{r} b ON b.p = x.p, range(1, (SELECT max(len(v)) FROM x) + 1) AS g(i) GROUP BY x.id, x.p, b.e) GROUP BY id, p, v)""")
        if r < rounds:
            out.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN (
                SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT p, e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, (SELECT max(len(v)) FROM x) + 1) AS g(i) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))""")
    return ", ".join(out)


def _lane(at: str, size: int) -> str:
    """A little-endian number of so many bytes of the hex string x, from byte `at`."""
    return f"('0x' || {' || '.join(f'substr(x, (2 * ({at}) + {2 * k + 1})::BIGINT, 2)' for k in reversed(range(size)))})::UBIGINT"


def _xor(a: str, b: str) -> str:
    return f"xor(({a})::UBIGINT, ({b})::UBIGINT)"


def _xxh64(of: str, seed: int) -> str:
    """The SELECT of (s, h): the XXH64 of the UTF-8 bytes of each distinct s of a table."""
    mixed = lambda k: _times(_turn(_times(k, _P2), 31), _P1)
    lanes = lambda first, last, step: f"list_transform(range({first}, {last}, {step}), lambda i: {_lane('i', 8)}::UHUGEINT)"
    four = [f"list_reduce({lanes(8 * k, 'n // 32 * 32', 32)}, lambda v, k: {_times(_turn(_mod('v + ' + _times('k', _P2)), 31), _P1)}, {v % (1 << 64)}::UHUGEINT) AS v{k}" for k, v in enumerate((seed + _P1 + _P2, seed + _P2, seed, seed - _P1))]
    long = _mod(" + ".join(_turn(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18))))
    for k in range(4):
        long = _mod(f"{_times(_xor(long, mixed(f'v{k}')), _P1)} + {_P4}::UHUGEINT")
    eight = _mod(f"{_times(_turn(_xor('h', mixed('k')), 27), _P1)} + {_P4}::UHUGEINT")
    rest = _mod(f"{_times(_turn(_xor('h', _times(_lane('n // 8 * 8', 4), _P1)), 23), _P2)} + {_P3}::UHUGEINT")
    one = _times(_turn(_xor("h", _times("k", _P5)), 11), _P1)
    return f"""SELECT s, xor(h, h >> 32) AS h FROM (SELECT s, {_times('xor(h, h >> 29)', _P3)}::UBIGINT AS h FROM (SELECT s, {_times('xor(h, h >> 33)', _P2)}::UBIGINT AS h FROM (
        SELECT s, list_reduce(list_transform(range(n // 8 * 8 + n % 8 // 4 * 4, n), lambda i: {_lane('i', 1)}::UHUGEINT), lambda h, k: {one}, h)::UBIGINT AS h FROM (
        SELECT s, x, n, CASE WHEN n % 8 >= 4 THEN {rest} ELSE h END AS h FROM (
        SELECT s, x, n, list_reduce({lanes('n // 32 * 32', 'n // 8 * 8', 8)}, lambda h, k: {eight}, h) AS h FROM (
        SELECT s, x, n, {_mod(f"CASE WHEN n >= 32 THEN {long} ELSE {seed + _P5}::UHUGEINT END + n::UHUGEINT")} AS h FROM (
        SELECT s, x, n, {', '.join(four)} FROM (SELECT DISTINCT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n FROM {of}))))))))"""


_FINGERPRINT = " + ".join(f"(2 * sum(h >> {k} & 1) > count(h))::UHUGEINT * {1 << k}::UHUGEINT" for k in range(64))


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filter": f"""
            WITH p AS (SELECT page_id, url,
                    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
                    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
                rules(rhost, rpath, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
                patterns(name, pattern, n, rank) AS (VALUES {_PATTERNS}),
                fits AS (SELECT p.*, r.rhost || r.rpath AS rule, r.action FROM p LEFT JOIN rules r
                    ON (p.host = r.rhost OR p.host LIKE '%.' || r.rhost) AND starts_with(p.path, r.rpath)),
                best AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY length(rule) DESC NULLS LAST) AS k FROM fits),
                hits AS (SELECT host || path AS subject, arg_max(name, (rank, -n)) AS pattern FROM (SELECT DISTINCT host, path FROM p) q
                    JOIN patterns ON regexp_matches(q.host || q.path, patterns.pattern) GROUP BY 1)
            SELECT page_id, host, path, rule, coalesce(action, CASE WHEN hits.pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
                CASE WHEN rule IS NULL THEN hits.pattern END AS pattern
            FROM best LEFT JOIN hits ON best.host || best.path = hits.subject WHERE k = 1""",
        "op5_simhash": f"""
            WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
                w AS (SELECT r, len(words) AS n, unnest(words) AS w0, generate_subscripts(words, 1) AS p FROM d),
                shingles AS (SELECT r, s FROM (SELECT r, n, p, concat_ws(' ', w0, lead(w0) OVER o, lead(w0, 2) OVER o) AS s FROM w WINDOW o AS (PARTITION BY r ORDER BY p)) WHERE p <= greatest(1, n - 2)),
                hashes AS MATERIALIZED ({_xxh64('shingles', 42)}),
                f AS MATERIALIZED (SELECT r, doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM d LEFT JOIN (SELECT r, ({_FINGERPRINT})::UBIGINT AS fp FROM shingles JOIN hashes USING (s) GROUP BY r) USING (r)),
                fps AS MATERIALIZED (SELECT fp, min(doc_id) AS least FROM f GROUP BY fp),
                links AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b, b.least FROM fps a JOIN fps b ON bit_count(xor(a.fp, b.fp)) <= 3),
                reach AS (SELECT a, b, least FROM links UNION SELECT reach.a, links.b, links.least FROM reach JOIN links ON reach.b = links.a)
            SELECT doc_id, format('{{:016x}}', fp) AS fingerprint, component_id FROM f JOIN (SELECT a AS fp, min(least) AS component_id FROM reach GROUP BY a) USING (fp)""",
        "op6_substring_dedup": """
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
                windows AS (SELECT r, a, md5(b[a + 1 : a + 200]) AS m FROM (SELECT r, b, unnest(range(0, octet_length(b) - 199)) AS a FROM d WHERE octet_length(b) >= 200)),
                starts AS (SELECT r, a FROM windows JOIN (SELECT m FROM windows GROUP BY m HAVING count(*) > 1) USING (m)),
                steps AS (SELECT r, a, coalesce(a - lag(a) OVER (PARTITION BY r ORDER BY a) > 200, true)::INT AS fresh FROM starts),
                spans AS (SELECT r, min(a) AS s, max(a) + 200 AS e FROM (SELECT r, a, sum(fresh) OVER (PARTITION BY r ORDER BY a) AS g FROM steps) GROUP BY r, g),
                gone AS (SELECT r, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r),
                ends AS (SELECT r, e AS s, lead(s) OVER (PARTITION BY r ORDER BY s) AS e FROM (SELECT r, s, e FROM spans UNION ALL SELECT r, -1, 0 FROM d)),
                kept AS (SELECT r, string_agg(hex(b[ends.s + 1 : coalesce(ends.e, octet_length(b))]), '' ORDER BY ends.s) AS h FROM ends JOIN d USING (r) GROUP BY r)
            SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256
            FROM d JOIN kept USING (r) LEFT JOIN gone USING (r)""",
        "op7_decontamination": f"""
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
                b AS (SELECT row_number() OVER () AS i, item_id, {_WORDS} AS words FROM benchmark),
                dw AS (SELECT *, {_AHEAD} FROM (SELECT r, len(words) AS n, unnest(words) AS w0, generate_subscripts(words, 1) - 1 AS p FROM d) WINDOW o AS (PARTITION BY r ORDER BY p)),
                bw AS (SELECT *, {_AHEAD} FROM (SELECT i, len(words) AS n, unnest(words) AS w0, generate_subscripts(words, 1) - 1 AS p FROM b) WINDOW o AS (PARTITION BY i ORDER BY p)),
                needs AS (SELECT i, item_id, len(words) AS n, CASE WHEN len(words) > {decontaminate.SHORT} THEN {decontaminate.MIN_WORDS} ELSE greatest(1, (len(words) * {round(decontaminate.MIN_SHARE * 100)} + 99) // 100) END AS need FROM b),
                bs AS (SELECT s.* FROM ({_seeds('bw', 'i')}) s JOIN needs USING (i)
                    WHERE CASE WHEN needs.n > {decontaminate.SHORT} THEN length(mask) > 4 ELSE mask = repeat('1', (needs.n // (needs.n - need + 1))::INT) END),
                tried AS (SELECT DISTINCT r, i, ds.p - bs.p AS shift FROM ({_seeds('dw', 'r')}) ds JOIN bs USING (mask, seed)),
                cells AS (SELECT tried.*, bw.n, dw.p, (bw.w0 = dw.w0)::INT AS same FROM tried JOIN bw USING (i) JOIN dw ON dw.r = tried.r AND dw.p = bw.p + tried.shift),
                sums AS (SELECT *, sum(3 * same - 2) OVER o - (3 * same - 2) AS before, sum(same) OVER o - same AS matched FROM cells WINDOW o AS (PARTITION BY r, i, shift ORDER BY p)),
                gains AS (SELECT *, before + 3 * same - 2 - least.f AS gain FROM
                    (SELECT *, min(struct_pack(f := before, s := p, m := matched)) OVER (PARTITION BY r, i, shift ORDER BY p) AS least FROM sums)),
                best AS (SELECT r, i, matched + same - least.m AS m, least.s AS s, p + 1 AS e FROM
                    (SELECT *, max(gain) OVER (PARTITION BY r, i, shift) AS top FROM gains WHERE n > {decontaminate.SHORT}) WHERE gain = top
                    QUALIFY row_number() OVER (PARTITION BY r, i, shift ORDER BY m DESC, e) = 1
                    UNION ALL SELECT r, i, sum(same), min(p), max(p) + 1 FROM cells WHERE n <= {decontaminate.SHORT} AND same = 1 GROUP BY r, i, shift)
            SELECT doc_id, item_id, m::BIGINT AS matched_words, n AS item_words, s AS start_word, e AS end_word
            FROM best JOIN needs USING (i) JOIN d USING (r) WHERE m >= need QUALIFY row_number() OVER (PARTITION BY r, i ORDER BY m DESC, s, e) = 1""",
        "op8_quotation_linking": rf"""
            WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, coalesce('c' || conv_id, '-') AS ck, turn, role, coalesce(text, '') AS text FROM conversations),
                raw AS (SELECT *, regexp_extract(line, '^(?:[ \t]{{0,3}}>)+ ?') AS mark
                    FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM m)),
                lines AS (SELECT id, n, length(mark) - length(replace(mark, '>', '')) AS level, substr(line, length(mark) + 1) AS body FROM raw),
                firsts AS (SELECT *, (level IS DISTINCT FROM lag(level) OVER (PARTITION BY id ORDER BY n) OR level = 0 AND regexp_full_match(body, '\s*'))::INT AS fresh FROM lines),
                numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY n) AS g, {_normal('body')} AS said FROM firsts),
                passages AS (SELECT id, level, g, {_normal('string_agg(body, chr(10) ORDER BY n)')} AS said, count(*) FILTER (said <> '') AS many,
                    string_agg(said, chr(10) ORDER BY n) FILTER (said <> '') AS run FROM numbered GROUP BY id, level, g),
                own AS (SELECT id, string_agg(body, chr(10) ORDER BY n) AS body, string_agg(said, chr(10) ORDER BY n) FILTER (said <> '') AS run FROM numbered WHERE level = 0 GROUP BY id),
                units AS (SELECT id, said FROM passages WHERE level = 0 UNION SELECT id, said FROM numbered WHERE level = 0 UNION SELECT id, {_normal('body')} FROM own),
                quotes AS (SELECT m.id, ck, turn, level, row_number() OVER (PARTITION BY m.id ORDER BY g) AS place, said, CASE WHEN many > 1 THEN run ELSE '' END AS run
                    FROM passages JOIN m USING (id) WHERE level > 0 AND said <> ''),
                wanted AS (SELECT DISTINCT ck, turn, level, place, said, run FROM quotes WHERE turn IS NOT NULL),
                met AS (SELECT w.*, m.turn AS original FROM wanted w JOIN m ON m.ck = w.ck AND m.turn < w.turn JOIN units u ON u.id = m.id AND u.said = w.said
                    UNION ALL SELECT w.*, m.turn FROM wanted w JOIN m ON m.ck = w.ck AND m.turn < w.turn JOIN own ON own.id = m.id
                    WHERE w.run <> '' AND contains(chr(10) || own.run || chr(10), chr(10) || w.run || chr(10))),
                links AS (SELECT ck, turn, arg_min(original, (level, place, original)) AS reply_to FROM met GROUP BY ck, turn),
                hits AS (SELECT DISTINCT ck, turn, said, run FROM met),
                threads AS (SELECT ck, turn, turn AS root, 0::BIGINT AS depth FROM (SELECT DISTINCT ck, turn FROM m WHERE turn IS NOT NULL) ANTI JOIN links USING (ck, turn)
                    UNION ALL SELECT l.ck, l.turn, t.root, t.depth + 1 FROM links l JOIN threads t ON t.ck = l.ck AND t.turn = l.reply_to),
                counts AS (SELECT id, count(*) AS n_quotes, count(h.said) AS n_linked FROM quotes q LEFT JOIN hits h ON h.ck = q.ck AND h.turn = q.turn AND h.said = q.said AND h.run = q.run GROUP BY id),
                marked AS (SELECT DISTINCT id FROM lines WHERE level > 0)
            SELECT m.conv_id, row_number() OVER (PARTITION BY m.ck ORDER BY root NULLS FIRST, m.turn NULLS FIRST) - 1 AS position, m.turn, role,
                CASE WHEN marked.id IS NULL THEN text ELSE trim(coalesce(own.body, ''), chr(10)) END AS text,
                reply_to, root, coalesce(depth, 0) AS depth, coalesce(n_quotes, 0)::INT AS n_quotes, coalesce(n_linked, 0)::INT AS n_linked
            FROM m LEFT JOIN threads t ON t.ck = m.ck AND t.turn = m.turn LEFT JOIN links l ON l.ck = m.ck AND l.turn = m.turn
                LEFT JOIN counts USING (id) LEFT JOIN marked USING (id) LEFT JOIN own USING (id)""",
        "op9_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AND row_number() OVER (PARTITION BY coalesce(text, ''), doc_id) = 1 AS kept,
                sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op10_mixture": f"""
            WITH s AS (SELECT source, sum(octet_length(encode(coalesce(text, ''))) + 1)::DOUBLE AS size FROM documents GROUP BY source),
                w AS (SELECT source, size, pow(size, {mixture.ALPHA}) AS weight FROM s),
                r AS (SELECT source, weight * ((SELECT sum(size) FROM w) / (SELECT sum(weight) FROM w)) / size AS rate FROM w),
                u AS (SELECT d.doc_id, d.source, r.rate, ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '-')), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 AS u
                    FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
                terms AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM r, range(0, 400) AS g(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 30)),
                cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
                n AS (SELECT u.doc_id, u.source, u.rate, count(*) AS copies FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= u.u GROUP BY ALL)
            SELECT doc_id, source, round(rate, 6) AS rate, copies, unnest(range(0, copies)) AS copy FROM n""",
        "op11_lexical_search": """
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
                s AS (SELECT count(*) FILTER (len(t) > 0) AS docs, coalesce(sum(len(t)), 0)::BIGINT AS terms FROM d),
                i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM benchmark),
                q AS MATERIALIZED (SELECT q, item_id, term, count(*) AS k FROM (SELECT q, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
                f AS MATERIALIZED (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
                w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term, docs),
                p AS (SELECT q, item_id, r, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
                    FROM q JOIN w USING (term) JOIN f USING (term), s GROUP BY q, item_id, r, doc_id),
                o AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM p WHERE score > 0)
            SELECT * FROM o WHERE rank <= 20""",
        "op12_vector_copies": f"""
            WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN {_FINITE} AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) THEN embedding::DOUBLE[] END AS e FROM embeddings),
                links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
                reached AS (SELECT a, b FROM links UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b),
                least AS (SELECT a AS r, min(v.vec_id) AS least FROM reached JOIN v ON v.r = reached.b GROUP BY a),
                many AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
            SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, least) AS component_id, vec_id IS NOT DISTINCT FROM least(vec_id, least) AS kept
            FROM v LEFT JOIN many USING (r) LEFT JOIN least USING (r)""",
        "op13_vector_codes": f"""
            WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS id, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE coalesce({_FINITE}, false)),
                x AS (SELECT id, p, v[(p * len(v) // 16 + 1)::BIGINT:((p + 1) * len(v) // 16)::BIGINT] AS v FROM k, range(0, 16) AS g(p)),
                {_codebooks(2)},
                c AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY id)
            SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
                (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
            FROM k JOIN c USING (id)""",
    }
