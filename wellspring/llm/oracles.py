"""Expected results, as DuckDB SQL, of the operators that SQL can express."""

from __future__ import annotations

from wellspring.llm import filter_audit, merkle, mixing, pii

SQL: dict[str, str] = {}


def _spans(kind: str, valid: str, score: str = "") -> str:
    """Rows (doc_id, kind, rank, s, e, score) of one kind."""
    rank = (pii.BASE_KINDS + pii.ADDED_KINDS).index(kind)
    pattern = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9]){11,30}",
        "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    }[kind]
    near = f"regexp_matches(lower(right(g0, {pii.CONTEXT_CHARS}) || ' ' || left(g1, {pii.CONTEXT_CHARS})), '{pii.CONTEXT[kind]}')"
    return f"""
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank, s, s + length(m) AS e, score FROM (
    SELECT doc_id, m, g0, g1,
           CAST(sum(length(g0)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s,
           CAST(round(100 * least(1.0, {pii.PRIOR[kind]} + CASE WHEN {near} THEN {pii.CONTEXT_GAIN} ELSE 0 END)) AS INTEGER) AS score
    FROM (SELECT doc_id, i, ms[i] AS m, gs[i] AS g0, gs[i + 1] AS g1
          FROM (SELECT doc_id, ms, gs, unnest(generate_series(1, len(ms))) AS i
                FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs
                      FROM d WHERE regexp_matches(t, '{pattern}'))))
    WINDOW w AS (PARTITION BY doc_id ORDER BY i))
  WHERE {valid}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = (
    f"length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, 20), lambda i: CASE WHEN (19 - i) % 2 = 0 "
    f"THEN CAST(lpad({_DIGITS}, 19, '0')[i] AS INTEGER) ELSE CAST(translate(lpad({_DIGITS}, 19, '0')[i], '0123456789', '0246813579') AS INTEGER) END)) % 10 = 0"
)
_BARE = "NOT regexp_matches(g0, '[A-Za-z0-9]$') AND NOT regexp_matches(g1, '^[A-Za-z0-9]')"
_MOVED = "(replace(m, ' ', '')[5:] || replace(m, ' ', '')[:4])"
_MOD_97 = (
    f"list_reduce(list_prepend(0, list_transform(string_split({_MOVED}, ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE CAST(c AS INTEGER) END)), "
    f"lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1"
)
_SMALL = "list_bool_and(list_transform(string_split(m, '.'), lambda q: length(ltrim(q, '0')) < 3 OR (length(ltrim(q, '0')) = 3 AND ltrim(q, '0') <= '255')))"
_VALID = {
    "email": "true",
    "ip": _SMALL,
    "card": _LUHN,
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": f"{_BARE} AND {_MOD_97} AND score >= 50",
    "national_id": f"{_BARE} AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$') AND score >= 50",
}

SQL["op1_personal_data"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(_spans(k, v) for k, v in _VALID.items())}),
by_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 4) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans,
         string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, rank) AS scores
  FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN by_doc USING (doc_id)
"""

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op5_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, w[i : i + 9] AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
grams AS (
  SELECT doc_id, i, n, w[i : i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item FROM grams JOIN windows USING (win)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def _number(key: str) -> str:
    return f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT)"


_WEIGHT = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
_PRIMES = ", ".join(str(m) for m in mixing.MULTIPLIERS)
_FIRST = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

SQL["op8_mixing"] = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs,
         row_number() OVER (ORDER BY source NULLS LAST) AS source_no
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (source_no - 1) % {len(mixing.WEIGHTS)} {_WEIGHT} END AS weight, source_size * {mixing.MOST} AS lim,
         (sum(source_size) OVER ()) * {mixing.SHARE}::DOUBLE AS total
  FROM sources),
filled AS (
  SELECT *, lim / weight <= (total - coalesce(sum(lim) OVER (ORDER BY lim / weight, source_no {_FIRST}), 0))
              / sum(weight) OVER (ORDER BY lim / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full
  FROM weighted),
aimed AS (
  SELECT *, CASE WHEN is_full THEN CAST(lim AS DOUBLE) ELSE (total - sum(CASE WHEN is_full THEN lim ELSE 0 END) OVER ())
              / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () * weight END AS target,
         CAST(ceil(source_size / {mixing.BLOCK}) AS BIGINT) AS blocks
  FROM filled),
slotted AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(blocks * {mixing.MOST}, CAST(floor(target * blocks / source_size + 0.5) AS BIGINT)) ELSE 0 END AS slots
  FROM aimed),
drawn AS (
  SELECT source_no, blocks, slot, slot // blocks AS pass, 'shift:' || source_no || ':' || (slot // blocks) AS seed,
         {_number("'shard:' || source_no || ':' || slot")}
             % (SELECT CAST(ceil(sum(slots) / {mixing.SLOTS_PER_SHARD}) AS BIGINT) FROM slotted) AS shard
  FROM (SELECT source_no, blocks, unnest(generate_series(0, slots - 1)) AS slot FROM slotted WHERE slots > 0)),
uses AS (
  SELECT source_no, block, shard, count(*) AS uses FROM (
    SELECT source_no, shard, CAST((([{_PRIMES}][{_number('seed')} % {len(mixing.MULTIPLIERS)} + 1] % blocks)::HUGEINT * (slot % blocks)
             + {_number("'b' || seed")}) % blocks AS BIGINT) AS block
    FROM drawn) GROUP BY ALL),
bucketed AS (
  SELECT doc_id, size, source_no, source_size, target,
         {_number("'d' || coalesce(CAST(doc_id AS VARCHAR), '')")} % CAST(ceil(n_docs / {mixing.BUCKET_ROWS}) AS BIGINT) AS bucket
  FROM sized JOIN slotted ON sized.source IS NOT DISTINCT FROM slotted.source),
placed AS (
  SELECT *, row_number() OVER () AS row_no,
         CAST(coalesce(sum(size) OVER (PARTITION BY source_no ORDER BY bucket, doc_id NULLS FIRST, size {_FIRST}), 0) AS BIGINT) AS start
  FROM bucketed),
pieces AS (
  SELECT *, greatest(block * {mixing.BLOCK} - start, 0) AS a, least((block + 1) * {mixing.BLOCK} - start, size) AS b
  FROM (SELECT *, unnest(generate_series(start // {mixing.BLOCK}, (start + size - 1) // {mixing.BLOCK})) AS block FROM placed WHERE size > 0)),
shown AS (SELECT row_no, sum(uses * (b - a)) AS taken, count(DISTINCT shard) AS n_shards
          FROM pieces JOIN uses USING (source_no, block) GROUP BY row_no)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, coalesce(n_shards, 0) AS n_shards
FROM placed LEFT JOIN shown USING (row_no)
"""


def _merkle_field(name: str, value: str = "") -> str:
    value = value or f"CAST({name} AS VARCHAR)"
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"


_MERKLE_ROW = [_merkle_field(name) for name in merkle.FIELDS]
_MERKLE_MORE = [_merkle_field(name, "CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR)" if name == "n_chars" else "") for name in merkle.FIELDS]
#: DuckDB has no crc32: eight shift steps a byte over the digits of the id.
_CRC32 = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda a, i: xor(a >> 1, (a & 1) * 3988292384::UBIGINT)))"""

SQL["op12_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS row_no, doc_id, lang, leaf,
         CASE WHEN xor({_CRC32}, 4294967295::UBIGINT) % {merkle.TAMPER} = 0 AND n_chars IS NOT NULL THEN changed ELSE leaf END AS used
  FROM (SELECT doc_id, lang, n_chars, sha256({" || ".join(_MERKLE_ROW)}) AS leaf, sha256({" || ".join(_MERKLE_MORE)}) AS changed FROM documents)),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS n,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row_no) - 1 AS i
  FROM leaves),
nodes(tree, level, n, i, h) AS (
  SELECT tree, 0, n, i, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, (n + 1) // 2, i // 2, sha256(string_agg(h, '' ORDER BY i))
  FROM nodes WHERE n > 1 GROUP BY tree, level, n, i // 2),
tops AS (SELECT tree, h AS subroot FROM nodes WHERE n = 1),
upper(level, n, i, h) AS (
  SELECT 0, count(*) OVER (), tree, subroot FROM tops
  UNION ALL
  SELECT level + 1, (n + 1) // 2, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, n, i // 2),
steps AS (
  SELECT a.tree, a.level, a.n, a.i, b.h AS sibling FROM nodes a LEFT JOIN nodes b ON b.tree = a.tree AND b.level = a.level AND b.i = xor(a.i, 1) WHERE a.n > 1),
upper_steps AS (
  SELECT a.level, a.n, a.i, b.h AS sibling FROM upper a LEFT JOIN upper b ON b.level = a.level AND b.i = xor(a.i, 1) WHERE a.n > 1),
climb(row_no, tree, level, n, i, h, proof) AS (
  SELECT row_no, tree, 0, n, i, used, '' FROM placed
  UNION ALL
  SELECT c.row_no, c.tree, c.level + 1, (c.n + 1) // 2, c.i // 2,
         sha256(CASE WHEN c.i % 2 = 1 THEN s.sibling || c.h ELSE c.h || coalesce(s.sibling, '') END), c.proof || coalesce(s.sibling, '')
  FROM climb c JOIN steps s ON s.tree = c.tree AND s.level = c.level AND s.i = c.i),
over_all(row_no, level, n, i, h, proof) AS (
  SELECT row_no, 0, (SELECT count(*) FROM tops), tree, h, proof FROM climb WHERE n = 1
  UNION ALL
  SELECT c.row_no, c.level + 1, (c.n + 1) // 2, c.i // 2,
         sha256(CASE WHEN c.i % 2 = 1 THEN s.sibling || c.h ELSE c.h || coalesce(s.sibling, '') END), c.proof || coalesce(s.sibling, '')
  FROM over_all c JOIN upper_steps s ON s.level = c.level AND s.i = c.i)
SELECT p.doc_id, p.leaf, t.subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = r.h AS verified
FROM placed p JOIN tops t USING (tree) JOIN over_all c ON c.row_no = p.row_no AND c.n = 1 JOIN upper r ON r.n = 1
"""

SQL["op13_filter_audit"] = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
failed AS (
  SELECT doc_id, part,
         (CASE WHEN len(ws) < {filter_audit.LEAST_WORDS} THEN 'A' ELSE '' END)
      || (CASE WHEN 100 * len(list_distinct(ws)) < {filter_audit.LEAST_DISTINCT} * len(ws) THEN 'B' ELSE '' END)
      || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {filter_audit.MOST_CAPITALS} * length(t) THEN 'C' ELSE '' END)
      || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
      || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM split),
marked AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
sets AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM failed LEFT JOIN marked USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(string_split('{filter_audit.FILTERS}', '')) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT o, s, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS s)),
met AS (
  SELECT part, o, s, f, n, good, toxic, contains(fails, f) AS has, fails = f AS only_it,
         len(list_intersect(string_split(fails, ''), list_filter(string_split(earlier, ''), lambda x: x <> ''))) > 0 AS before
  FROM sets, steps),
counted AS (
  SELECT part, o, s, f, sum(CASE WHEN NOT has AND NOT before THEN n ELSE 0 END) AS kept, sum(CASE WHEN has AND NOT before THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN has AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN only_it THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN has AND NOT before THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN has AND NOT before THEN toxic ELSE 0 END) AS toxic_lost
  FROM met GROUP BY part, o, s, f)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
