"""DuckDB SQL of the text queries that SQL can express; the SQL counts all positions instead of hashing them."""

from __future__ import annotations

from driftpanel.llm import decontaminate, link_graph, mixing, substrings

#: White space between words, for splitting.
_SPACE = r"[\x20\x09-\x0D]+"


def _words(text: str, between: str) -> str:
    return f"list_filter(string_split_regex({text}, '{between}'), lambda w: w <> '')"


def decontamination() -> str:
    """Every alignment of every document with every item, from equal words; no seeds."""
    words = _words("lower(coalesce(text, ''))", r"[^\p{L}\p{N}]+")
    allowed = " ".join(f"WHEN run >= {n} THEN {e}" for n, e in decontaminate.TOLERANCE)
    return f"""
WITH items AS MATERIALIZED (
  SELECT w, min(item_id) AS item_id, count(*) AS n_items, len(w) AS n, least({decontaminate.REACH}, len(w)) AS run
  FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) >= {decontaminate.MIN_WORDS} GROUP BY w),
item_words AS (SELECT item_id, n_items, n, run, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM items),
texts AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents),
doc_words AS (SELECT doc_id, len(w) AS doc_n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS doc_pos FROM texts),
hits AS MATERIALIZED (SELECT *, doc_pos - pos AS shift, CASE {allowed} END AS allowed FROM doc_words JOIN item_words USING (word)),
aligned AS (
  SELECT doc_id, item_id, shift FROM hits GROUP BY doc_id, item_id, shift
  HAVING count(*) >= max(run - allowed) AND least(max(n), max(doc_n) - shift) - greatest(0, -shift) >= max(run)),
runs AS (
  SELECT doc_id, item_id, n_items, run - allowed AS least_equal,
    count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos RANGE BETWEEN run - 1 PRECEDING AND CURRENT ROW) AS equal
  FROM hits JOIN aligned USING (doc_id, item_id, shift)),
by_item AS (
  SELECT doc_id, item_id, max(n_items) AS n_items, max(equal) AS equal FROM runs WHERE equal >= least_equal GROUP BY doc_id, item_id)
SELECT doc_id, true AS contaminated, CAST(sum(n_items) AS BIGINT) AS n_items, min(item_id) AS first_item, CAST(max(equal) AS INTEGER) AS most_equal
FROM by_item GROUP BY doc_id"""


def mixture(weights: tuple[int, ...] = (1, 2, 3), most: int = mixing.MOST_COPIES) -> str:
    """Documents of a source in the order of their hashes up to the threshold; a sort instead of histograms."""
    listed = ", ".join(map(str, weights))
    return rf"""
WITH sizes AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substring(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS hash
  FROM documents),
ranked AS (
  SELECT source, source_size, CAST([{listed}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1] AS DOUBLE) AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS rank, CAST({most} * source_size AS DOUBLE) AS bound
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source)),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(bound) OVER lower, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER lower, 0.0)) AS level
  FROM ranked WINDOW lower AS (ORDER BY bound / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wanted AS (
  SELECT source, source_size,
    CASE WHEN bound <= level * weight THEN bound ELSE coalesce(max(CASE WHEN bound > level * weight THEN level END) OVER (), 0.0) * weight END AS target
  FROM levels),
needs AS (
  SELECT *, copies * source_size AS whole, greatest(target - copies * source_size, 0.0) AS need
  FROM (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM wanted)),
running AS (
  SELECT source, hash, size, sum(size) OVER (PARTITION BY source ORDER BY hash) AS upto
  FROM (SELECT source, hash, sum(size) AS size FROM sizes GROUP BY source, hash)),
crossings AS (
  SELECT n.source, CASE WHEN r.upto - n.need < n.need - (r.upto - r.size) THEN r.hash + 1 ELSE r.hash END AS below
  FROM running r JOIN needs n ON r.source IS NOT DISTINCT FROM n.source WHERE r.size > 0 AND r.upto >= n.need AND r.upto - r.size < n.need)
SELECT s.doc_id, s.size, n.source_size, n.target, CAST((n.copies + CASE WHEN s.hash < coalesce(c.below, 0) THEN 1 ELSE 0 END) * s.size AS BIGINT) AS taken
FROM sizes s JOIN needs n ON s.source IS NOT DISTINCT FROM n.source LEFT JOIN crossings c ON s.source IS NOT DISTINCT FROM c.source"""


def repeated_substrings(window: int = substrings.WINDOW) -> str:
    """Every window as its words; a word goes when a window that covers it starts in a smaller document too."""
    return f"""
WITH texts AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS line, {_words("coalesce(text, '')", _SPACE)} AS w FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, line, pos, md5(array_to_string(list_slice(w, pos, pos + {window - 1}), ' ')) AS body
  FROM (SELECT doc_id, line, w, unnest(range(1, len(w) - {window - 2})) AS pos FROM texts)),
late AS (
  SELECT line, pos FROM windows JOIN (SELECT body, min(doc_id) AS first_doc FROM windows GROUP BY body) USING (body) WHERE doc_id > first_doc),
gone AS (SELECT DISTINCT line, unnest(range(pos, pos + {window})) AS pos FROM late),
kept AS (
  SELECT line, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE g.pos IS NULL) AS body
  FROM (SELECT line, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts) LEFT JOIN gone g USING (line, pos) GROUP BY line)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (line)"""


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rule(host: str, path: str, answer: int, rules) -> str:
    """The longest rule that fits: its name (``answer`` 0) or its verdict (1)."""
    cases = "".join(
        f" WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, v)[answer]}'"
        for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0]), reverse=True)
    )
    return f"(CASE{cases} END)"


def _propagated(name: str, seeds: str, src: str, dst: str, steps: int, damping: float) -> str:
    """Common table expressions ``name0`` to ``name<steps>`` of a personalised PageRank from ``seeds`` along ``src -> dst``."""
    parts = [
        f"{name}_shares AS MATERIALIZED (SELECT {src} AS src, {dst} AS dst, weight / sum(weight) OVER (PARTITION BY {src}) AS share FROM links)",
        f"{name}_fixed AS MATERIALIZED (SELECT host, {1 - damping} / (SELECT count(*) FROM {seeds}) AS rank FROM {seeds})",
        f"{name}0 AS (SELECT host, rank FROM {name}_fixed)",
    ]
    for k in range(steps):
        parts.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT host, sum(rank) AS rank FROM (SELECT dst AS host, {damping} * r.rank * s.share AS rank "
            f"FROM {name}_shares s JOIN {name}{k} r ON s.src = r.host UNION ALL SELECT host, rank FROM {name}_fixed) GROUP BY host)"
        )
    return ",\n".join(parts)


def url_verdicts() -> str:
    rules, damping, steps = link_graph.RULES, link_graph.DAMPING, link_graph.STEPS
    names = ", ".join(f"'{n}'" for n in link_graph.BLOCKED_NAMES)
    whole = _rule("host", "'/'", 1, [r for r in rules if r[1] == "/"])
    link = r"""(?i)href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s<>]+)"""
    return f"""
WITH parsed AS MATERIALIZED (
  SELECT page_id, html, {_lower("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
links AS MATERIALIZED (
  SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight
  FROM (SELECT host AS src, {_lower("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM parsed)
  WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
hosts AS MATERIALIZED (SELECT host FROM parsed UNION SELECT src FROM links UNION SELECT dst FROM links),
seeds AS MATERIALIZED (
  SELECT host, {whole} AS v, list_has_any(string_split_regex(host, '[.\\-_0-9]+'), [{names}]) AS bad FROM hosts WHERE host <> ''),
trusted AS MATERIALIZED (SELECT host FROM seeds WHERE v = 'allow' AND NOT bad),
blocked AS MATERIALIZED (SELECT host FROM seeds WHERE v = 'block' OR bad),
{_propagated("trust", "trusted", "src", "dst", steps, damping)},
{_propagated("distrust", "blocked", "dst", "src", steps, damping)},
judged AS (
  SELECT host, CASE WHEN coalesce(d.rank, 0) >= {link_graph.THRESHOLD * (1 - damping)} / greatest((SELECT count(*) FROM blocked), 1)
    AND coalesce(d.rank, 0) > coalesce(t.rank, 0) THEN 'block' ELSE 'allow' END AS verdict
  FROM hosts LEFT JOIN trust{steps} t USING (host) LEFT JOIN distrust{steps} d USING (host))
SELECT page_id, host, path, {_rule("host", "path", 0, rules)} AS rule, coalesce({_rule("host", "path", 1, rules)}, j.verdict) AS verdict
FROM parsed p JOIN judged j USING (host)"""


ORACLES = {
    "op1_decontaminate": decontamination(),
    "op3_mix": mixture(),
    "op4_substrings": repeated_substrings(),
    "op10_urls": url_verdicts(),
}

#: Insertions from each state of the wanted roles: state, how many, state then, lines. Nothing yet 0, after s 1, after u 2, after a 3.
CHAINS = ", ".join(
    f"({state}, {m}, {([state, *path])[m]}, {lines[:m]!r}::VARCHAR[])"
    for state, path, lines in (
        (0, (2, 3), ["user:", "assistant:"]),
        (1, (2, 3), ["user:", "assistant:"]),
        (2, (3, 2), ["assistant:", "user:"]),
        (3, (2, 3), ["user:", "assistant:"]),
    )
    for m in range(3)
)
CONVERSATIONS = rf"""
WITH RECURSIVE chains(s, m, t, lines) AS (VALUES {CHAINS}),
keyed AS (
    SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
    FROM conversations
),
drawn AS (
    SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda ch: ord(ch)::BIGINT)),
        lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda x, j: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS draw
    FROM keyed
),
hurt AS (
    SELECT c, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
        CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM drawn
),
placed AS (
    SELECT c, turn, role, text,
        row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS i,
        right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
    FROM hurt
),
faulty AS (
    SELECT *, left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY c ORDER BY i), 1) AS previous,
        CASE WHEN last = '' THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd'
            WHEN last IN ('.', '!', '?') THEN '' ELSE 't' END AS fault
    FROM placed
),
edits AS (
    SELECT c, i, s, s AS t, 2 AS cost, 'D' AS letter, []::VARCHAR[] AS lines FROM faulty, range(4) AS states(s)
    UNION ALL
    SELECT c, i, s, t, CASE fault WHEN 't' THEN 5 ELSE 0 END, 'K', [role || ':' || text]
    FROM faulty JOIN (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) AS follow(s, initial, t) USING (initial) WHERE fault IN ('', 't')
    UNION ALL
    SELECT c, i, s, t, CASE fault WHEN 't' THEN 6 ELSE 1 END, 'R', [lines[1] || text] FROM faulty, chains WHERE m = 1 AND fault IN ('', 't')
),
step(c, i, s, cost, audit, lines) AS (
    SELECT c, 0::BIGINT, t, 5::BIGINT * m, repeat('I', m), lines FROM (SELECT DISTINCT c FROM placed), chains WHERE s = 0
    UNION ALL
    SELECT c, i, t, min(cost), arg_min(audit, (cost, audit)), arg_min(lines, (cost, audit)) FROM (
        SELECT p.c, e.i, n.t, p.cost + e.cost + 5 * n.m AS cost, p.audit || e.letter || repeat('I', n.m) AS audit,
            list_concat(list_concat(p.lines, e.lines), n.lines) AS lines
        FROM step AS p JOIN edits AS e ON e.c = p.c AND e.i = p.i + 1 AND e.s = p.s JOIN chains AS n ON n.s = e.t
    ) GROUP BY c, i, t
),
ends AS (SELECT c, max(i) AS i FROM placed GROUP BY c),
best AS (
    SELECT c, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit, arg_min(lines, (cost, audit)) AS lines
    FROM step JOIN ends USING (c, i) WHERE s IN (0, 3) GROUP BY c
),
counts AS (
    SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY c
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
    coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM keyed) LEFT JOIN counts USING (c) LEFT JOIN best USING (c)
"""
ORACLES["op13_conversations"] = CONVERSATIONS


def phrases(least: int = 30, longest: int = 4, top: int = 2000) -> str:
    """All phrases of up to four words, counted one by one; every cut of every candidate."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
runs AS (SELECT lang, w, i, unnest(range(1, least({longest}, len(w) - i + 1) + 1)) AS k FROM starts),
counts AS MATERIALIZED (SELECT lang, w[i : i + k - 1] AS p, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= {least}),
candidates AS MATERIALIZED (SELECT lang, p, f AS a FROM counts WHERE len(p) > 1),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM candidates),
scores AS (
    SELECT c.lang, c.p, c.a, k, x.f AS l, y.f AS r, 2000000::HUGEINT * c.a // (x.f + y.f) AS score
    FROM cuts AS c JOIN counts AS x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN counts AS y ON y.lang = c.lang AND y.p = c.p[k + 1:]
),
best AS (SELECT lang, p, a, min(score) AS score, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r FROM scores GROUP BY lang, p, a),
spans AS (SELECT lang, p, a, unnest(range(2, len(p))) AS size FROM candidates),
inner_spans AS (SELECT lang, p, a, size, unnest(range(1, len(p) - size + 2)) AS i FROM spans),
around AS (SELECT lang, p[i : i + size - 1] AS p, max(a) AS around FROM inner_spans GROUP BY ALL),
ranked AS (
    SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM best LEFT JOIN around USING (lang, p)
    WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a
)
SELECT * FROM (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM ranked JOIN totals USING (lang)
) WHERE rank <= {top}"""


ORACLES["op11_collocations"] = phrases()
