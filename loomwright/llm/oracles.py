"""SQL for DuckDB that gives the rows of the registered queries, where SQL can."""

from __future__ import annotations

from . import quality_rules, ranks, secret_scan, source_mixing, url_rules

UPPER, LOWER = url_rules.UPPER, url_rules.LOWER
WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id, doc_id AS o FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.o = e.a),
m AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)"""


def _op2() -> str:
    shares = {"symbol_share": "CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END", "dup_line_share": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END", "repeat_share": "CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END", "upper_share": "CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END"}
    null = lambda c: "CAST(NULL AS DOUBLE)" if c is None else str(c)
    settings = ", ".join(f"({i}, {', '.join(null(cutoffs[level] if r in some else None) for r, cutoffs in quality_rules.LEVELS.items())})" for i, (level, some) in enumerate(quality_rules.SETTINGS))
    over = lambda t: " OR ".join(f"coalesce({r} > {t}.{r}_cut, false)" for r in shares)
    p = quality_rules.RISK
    return f"""WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, {WORDS.format("text")} AS w FROM t),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS three FROM w WHERE len(w) >= 3),
d AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, three) AS c FROM g),
v AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest([i, i+1, i+2]) AS q FROM d WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
f AS (SELECT doc_id, rid, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
 coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper FROM t JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN v USING (rid)),
s AS (SELECT *, {", ".join(f"{e} AS {r}" for r, e in shares.items())} FROM f),
x AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s),
cfg(i, {", ".join(f"{r}_cut" for r in shares)}) AS (VALUES {settings}),
lab AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper) AS rn FROM x) WHERE rn = 1),
k AS (SELECT stratum, i, count(*) FILTER (good) AS n, count(*) FILTER (good AND hit) AS k, count(*) FILTER (NOT good AND hit) AS bad FROM (SELECT stratum, cfg.i, good, {over("cfg")} AS hit FROM one JOIN lab USING (doc_id) CROSS JOIN cfg WHERE NOT base_failed) GROUP BY ALL),
c AS (SELECT *, CASE WHEN n = 0 OR k > n * {p} THEN false ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) * (SELECT count(*) FROM k WHERE n > 0) <= {quality_rules.DELTA} END AS proven FROM k),
m AS (SELECT stratum, arg_max(i, bad * 1000 - i) AS i FROM c WHERE proven GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {over("cfg")}) AS kept FROM x LEFT JOIN m USING (stratum) LEFT JOIN cfg USING (i)"""


OP5 = f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(verdict, host, path) AS (VALUES {", ".join(map(str, url_rules.RULES))}),
m AS (SELECT page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS rn FROM h JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path))
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id AND rn = 1"""


def _op7() -> str:
    quoted = lambda p: p.replace("'", "''")

    def located(kind: int, pattern: str, group: int, least: int) -> str:
        gaps, found = f"string_split_regex(text, '{quoted(pattern)}')", f"regexp_extract_all(text, '{quoted(pattern)}', 0)"
        return f"""SELECT doc_id, text, {kind} AS kind, begin, begin + length(whole) AS stop FROM (SELECT doc_id, text, whole, part, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i-1], lambda g: length(g))), 0) AS begin
 FROM (SELECT *, unnest(found) AS whole, unnest(regexp_extract_all(text, '{quoted(pattern)}', {group})) AS part, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, text, {gaps} AS gaps, {found} AS found FROM t))) WHERE length(part) >= {least}"""

    w, b = secret_scan.WINDOW, secret_scan.BITS

    def between(spans: str, cuts: str) -> str:
        """What is left of spans (begin, stop) between their cuts (cb, cs), where it is as long as a window."""
        window = "(PARTITION BY doc_id, begin ORDER BY cb, cs ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        return f"""SELECT p.doc_id, p.pb AS begin, p.pe AS stop, substr(t.text, CAST(p.pb AS BIGINT) + 1, CAST(p.pe - p.pb AS BIGINT)) AS run FROM (SELECT doc_id, greatest(begin, coalesce(max(cs) OVER {window}, begin)) AS pb, cb AS pe
 FROM ({cuts} UNION ALL SELECT doc_id, begin, stop, stop AS cb, stop AS cs FROM {spans})) p JOIN t USING (doc_id) WHERE p.pe - p.pb >= {w}"""

    others = between("cand", "SELECT c.doc_id, c.begin, c.stop, b.begin AS cb, b.stop AS cs FROM cand c JOIN base b ON b.doc_id = c.doc_id AND b.begin < c.stop AND c.begin < b.stop")
    tokens = f"SELECT doc_id, begin, stop, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS i, tokens FROM (SELECT *, string_split_regex(run, '{secret_scan.SEPARATOR}') AS tokens FROM part)"
    words = between("part", f"SELECT doc_id, begin, stop, tb - 1 AS cb, tb + length(token) + 1 AS cs FROM (SELECT *, begin + i - 1 + coalesce(list_sum(list_transform(tokens[1:i-1], lambda x: length(x))), 0) AS tb FROM ({tokens})) WHERE regexp_matches(token, '{secret_scan.ALLOWED_WORDS}')")
    kinds = "[" + ", ".join(f"'{k}'" for k in secret_scan.KINDS) + "]"
    joined = lambda extra: f"coalesce(string_agg({kinds}[kind + 1] || ':' || begin || ':' || stop, ',' ORDER BY begin, kind, stop) FILTER ({extra}), '')"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({located(0, secret_scan.ASSIGN, 1, 6)} UNION ALL {located(1, secret_scan.ACCESS, 0, 1)} UNION ALL {located(2, secret_scan.HEX, 0, 1)}),
cand AS (SELECT doc_id, begin, stop FROM ({located(3, secret_scan.CANDIDATE, 0, 1)})),
part AS ({others}),
whole AS ({words}),
free AS (SELECT *, CASE WHEN regexp_full_match(run, '[0-9a-fA-F]+') THEN {b["hex"]} WHEN regexp_matches(run, '[a-z]') AND regexp_matches(run, '[A-Z]') THEN {b["mixed"]} ELSE {b["one_case"]} END AS bits FROM whole
 WHERE regexp_matches(run, '[0-9]') AND regexp_matches(run, '[A-Za-z]') AND NOT regexp_matches(run, '{secret_scan.ALLOWED_RUN}')),
win AS (SELECT doc_id, begin, bits, i, substr(run, i + 1, {w}) AS s FROM (SELECT *, unnest(range(0, length(run) - {w - 1})) AS i FROM free)),
chr AS (SELECT doc_id, begin, bits, i, x, count(*) AS c FROM (SELECT *, unnest(string_split(s, '')) AS x FROM win) GROUP BY ALL),
ent AS (SELECT doc_id, begin, i FROM chr GROUP BY doc_id, begin, bits, i HAVING log2({w}) - sum(c * log2(c)) / {w} >= bits - 1e-9),
found AS (SELECT doc_id, kind, begin, stop FROM base UNION ALL SELECT doc_id, 3, begin + min(i), begin + max(i) + {w} FROM ent GROUP BY doc_id, begin)
SELECT t.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, sha256({joined("kind < 3")}) AS base_sha256, {joined("kind >= 0")} AS spans FROM t LEFT JOIN (SELECT doc_id, kind, CAST(begin AS BIGINT) AS begin, CAST(stop AS BIGINT) AS stop FROM found) f ON t.doc_id = f.doc_id GROUP BY t.doc_id"""


OP10 = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT vec_id, vec_id AS o FROM v UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.o = e.a),
m AS (SELECT vec_id, min(o) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n ON n.a = m.vec_id"""

P, B = source_mixing.PERIOD, source_mixing.BLOCK
OP3 = f"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS s, CAST(greatest(coalesce(length(text), 0), 1) AS BIGINT) AS size FROM documents),
c AS (SELECT s, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY s),
e AS (SELECT s, size, (size ** {source_mixing.TEMPER}) / sum(size ** {source_mixing.TEMPER}) OVER () * ({P} - count(*) OVER ()) AS exact FROM c),
f AS (SELECT s, size, CAST(1 + floor(exact) AS BIGINT) AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, s) AS rn FROM e),
k AS (SELECT s, size, base + CASE WHEN rn <= {P} - sum(base) OVER () THEN 1 ELSE 0 END AS k FROM f),
l AS (SELECT list(k ORDER BY s) AS ks, list(s ORDER BY s) AS names FROM k),
t AS (SELECT CAST(0 AS BIGINT) AS slot, list_transform(ks, lambda x: CAST(0 AS BIGINT)) AS nxt, CAST(NULL AS BIGINT) AS j FROM l
 UNION ALL SELECT slot + 1, list_transform(range(1, len(ks) + 1), lambda i: nxt[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick FROM (SELECT slot, nxt, ks,
 list_min(list_transform(range(1, len(ks) + 1), lambda i: CASE WHEN nxt[i] < ks[i] AND nxt[i] * {P} // ks[i] <= slot THEN (((nxt[i] + 1) * {P} + ks[i] - 1) // ks[i] * 2048 + {P} - ks[i]) * 2048 + i END)) % 2048 AS pick FROM t, l) WHERE slot < {P}),
p AS (SELECT names[j] AS s, list(slot - 1 ORDER BY slot) AS places FROM t, l WHERE j IS NOT NULL GROUP BY names[j]),
x AS (SELECT s, k, places, ((size + {B} - 1) // {B}) // k * {P} + places[((size + {B} - 1) // {B}) % k + 1] AS dry FROM k JOIN p USING (s)),
h AS (SELECT *, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % (SELECT greatest({ranks.LEAST}, (count(*) + {ranks.SHARE} - 1) // {ranks.SHARE}) FROM d) AS share FROM d),
b AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY s ORDER BY share, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // {B} AS block FROM h)
SELECT doc_id, source, block, block // k * {P} + places[block % k + 1] AS slot, block // k * {P} + places[block % k + 1] < (SELECT min(dry) FROM x) AS in_mix FROM b JOIN x USING (s)"""

OP11 = """WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.rid <> c.rid),
r AS (SELECT query_id, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def _op12(levels: int = 8) -> str:
    """Levels unrolled: enough for 8 ** levels rows of a language."""
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(value, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    ctes = [f"""d AS (SELECT *, {leaf("text")} AS leaf, {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS lowered FROM documents)"""]

    def tree(name: str, start: str) -> str:
        """For each level: nodes with place, their run's digests, and whether the group has more than one."""
        ctes.append(f"{name}0 AS ({start})")
        for i in range(levels):
            ctes.append(f"{name}r{i} AS (SELECT g, pos // 8 AS run, list(h ORDER BY pos) AS hs, any_value(n) AS n FROM {name}{i} GROUP BY g, pos // 8)")
            ctes.append(f"{name}{i + 1} AS (SELECT g, run AS pos, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 7) // 8 AS n FROM {name}r{i})")
        return f"{name}{levels}"

    def climb(name: str, rows: str, own: str) -> str:
        """From each row (g, pos, proof, folded) up all levels of its group."""
        for i in range(levels):
            own_place = f"CAST(x.pos // {8**i} AS BIGINT)"
            after = f"array_to_string(r.hs[{own_place} % 8 + 2:], '')"
            before = f"array_to_string(r.hs[:{own_place} % 8], '')"
            ctes.append(f"""{own}{i} AS (SELECT x.* REPLACE (x.proof || CASE WHEN r.n = 1 THEN '' ELSE {before} || {after} END AS proof, CASE WHEN r.n = 1 THEN x.folded ELSE sha256({before} || x.folded || {after}) END AS folded)
 FROM {rows} x JOIN {name}r{i} r ON r.g IS NOT DISTINCT FROM x.g AND r.run = x.pos // {8 ** (i + 1)})""")
            rows = f"{own}{i}"
        return rows

    last = tree("l", "SELECT lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM d")
    ctes.append(f"sub AS (SELECT g AS lang, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos FROM {last})")
    top = tree("t", "SELECT 0 AS g, pos, subroot AS h, count(*) OVER () AS n FROM sub")
    ctes.append("""x AS (SELECT doc_id, lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf, '' AS proof, CASE WHEN crc = 0 THEN lowered ELSE leaf END AS folded FROM d JOIN crc USING (doc_id))""")
    # CRC-32 bit by bit over the decimal id.
    ctes.insert(1, """crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384::BIGINT) ELSE s // 2 END)), 4294967295::BIGINT) % 3 AS crc FROM (SELECT DISTINCT doc_id FROM documents))""")
    up = climb("l", "x", "a")
    ctes.append(f"y AS (SELECT a.doc_id, a.leaf, s.subroot, 0 AS g, s.pos, a.proof, a.folded FROM {up} a JOIN sub s ON s.lang IS NOT DISTINCT FROM a.g)")
    done = climb("t", "y", "b")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, (SELECT h FROM {top}) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM {top}) AS verified FROM {done}"


def _op13(rounds: int = 4, k: int = 256) -> str:
    """Rounds unrolled."""
    ctes = [
        "v AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "w AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, x) AS rid, * FROM v)",
        "p AS MATERIALIZED (SELECT rid, vec_id, label, part, x[part * len(x) // 4 + 1 : (part + 1) * len(x) // 4] AS x FROM w, range(4) r(part))",
        f"c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x AS c FROM p WHERE rid <= {k})",
    ]
    for i in range(rounds + 1):
        # Differences are whole numbers, so sums of squares in doubles are exact.
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT rid, part, any_value(vec_id) AS vec_id, any_value(label) AS label, any_value(x) AS x, min(d * {k} + entry) AS best
 FROM (SELECT p.rid, p.part, p.vec_id, p.label, p.x, c.entry, CAST(list_inner_product(p.x, p.x) + list_inner_product(c.c, c.c) - 2 * list_inner_product(p.x, c.c) AS BIGINT) AS d FROM p JOIN c{i} c USING (part)) GROUP BY rid, part)""")
        if i < rounds:
            ctes.append(f"""s{i} AS (SELECT part, entry, list(m ORDER BY j) AS c FROM (SELECT part, best % {k} AS entry, j, floor(CAST(sum(y) AS DOUBLE) / count(*)) AS m FROM (SELECT part, best, unnest(x) AS y, unnest(range(len(x))) AS j FROM a{i}) GROUP BY ALL) GROUP BY ALL)""")
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(s.c, o.c) AS c FROM c{i} o LEFT JOIN s{i} s USING (part, entry))")
    ctes.append(f"e AS (SELECT rid, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(best % {k} AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best // {k}) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)")
    return f"""WITH {", ".join(ctes)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256 FROM e"""


ORACLES: dict[str, str] = {"op3_source_mixing": OP3, "op1_minhash_dedup": OP1, "op2_quality_rules": _op2(), "op5_url_rules": OP5, "op7_secret_scan": _op7(), "op10_embedding_dedup": OP10, "op11_topk_search": OP11, "op12_merkle_manifest": _op12(), "op13_vector_codes": _op13()}
