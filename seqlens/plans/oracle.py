"""Independent DuckDB formulations of every registered query.

Each string runs on DuckDB with the raw test tables registered as views. The
fixture mapping (``sources.fixture``) is restated as CTEs, then the query is
written the plain single-node way: ``median``/``quantile_cont`` instead of
partial percentiles, ``ntile`` over one window instead of ranged positions,
numeric hex casts instead of the positional decode where the text is canonical.
Constants are stated here again, so that a wrong one in the library shows.
"""

from __future__ import annotations

# Stated again here, apart from the library's own constants.
OFFICIAL, OTHER = "0x0000000000000006", "0x0000000000000007"
CONTRACT = "0x018108b32cea514a78ef1b0e4a0753e855cdf620bc0565202c02456f618c4dc4"
SELECTOR = "0x99cd8bde557814842a3121e8ddfd433a539b8c9f14bf31ebf108d12e6196e9"

_NORM = "('0x' || lpad(regexp_replace(lower({c}), '^(0x)?0*', ''), 64, '0'))"


def _spelt(value: str) -> str:
    d = value[2:].lstrip("0") or "0"
    return f"(['{value}', '0x{d}', '0x{d.upper()}', '0x{d:0>64}'])[o_orderkey % 4 + 1]"


# Position in the lowercase hex alphabet less one; a missing character counts 0.
_POSITIONAL = "(" + " + ".join(
    f"CASE WHEN length(score) < {p} THEN 0 ELSE instr('0123456789abcdef', substr(score, {p}, 1)) - 1 END * {16 ** (18 - p)}::BIGINT"
    for p in range(7, 19)) + ")"

_BASE = f"""
token_metadata AS (
  SELECT CAST(event_id AS VARCHAR) AS id,
         CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS settings_id,
         CASE WHEN event_type = 'signup' THEN '{OTHER}' ELSE '{OFFICIAL}' END AS minted_by
  FROM events),
token_scores AS (
  SELECT CAST(event_id AS VARCHAR) AS id, printf('0x%016x', CAST(floor(value * 10) AS BIGINT)) AS score,
         ts AS executed_at
  FROM events),
token_owners AS (
  SELECT CAST(event_id AS VARCHAR) AS token_id, printf('0x%064x', user_id) AS owner FROM events),
scoped AS (
  SELECT id FROM token_metadata
  WHERE settings_id = 1 AND minted_by = '{OFFICIAL}'),
games AS (
  SELECT o.owner, s.id, s.executed_at, s.score,
         CAST('0x' || substr(s.score, 7, 12) AS BIGINT) AS sc
  FROM scoped m JOIN token_scores s ON s.id = m.id JOIN token_owners o ON o.token_id = m.id),
seq AS (
  SELECT *,
         ROW_NUMBER() OVER (PARTITION BY owner ORDER BY executed_at NULLS FIRST, id) AS game_no,
         COUNT(*) OVER (PARTITION BY owner) AS n
  FROM games),
v AS (SELECT * FROM seq WHERE sc BETWEEN 1 AND 3000),
members AS (
  SELECT printf('0x%064x', c_custkey) AS addr FROM customer WHERE c_mktsegment = 'BUILDING'),
mint_events AS (
  SELECT {_spelt(CONTRACT)} AS address,
         date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 150 AS block_number,
         [{_spelt(SELECTOR)},
          CASE WHEN o_orderstatus = 'F' THEN {_spelt('0x0')} ELSE '0x1' END,
          printf('0x%x', o_custkey), printf('0x%x', o_orderkey), '0x0'] AS keys
  FROM orders),
mp AS (
  SELECT printf('0x%064x', CAST(keys[3] AS BIGINT)) AS addr_norm FROM mint_events
  WHERE {_NORM.format(c='address')} = {_NORM.format(c=f"'{CONTRACT}'")}
    AND block_number BETWEEN 700000 AND 1700000
    AND {_NORM.format(c='keys[1]')} = {_NORM.format(c=f"'{SELECTOR}'")} AND {_NORM.format(c='keys[2]')} = {_NORM.format(c="'0x0'")}),
spelt_scores AS (
  SELECT CAST(event_id AS VARCHAR) AS id,
         CASE event_id % 7 WHEN 0 THEN t WHEN 1 THEN upper(t) WHEN 2 THEN substr(t, 3) WHEN 3 THEN substr(t, 1, 17)
              WHEN 5 THEN '0xffff' || substr(t, 7) WHEN 6 THEN substr(t, 1, 16) || 'g' || substr(t, 18, 1) END AS score
  FROM (SELECT event_id, printf('0x%016x', CAST(floor(value * 10) AS BIGINT)) AS t FROM events)),
spelt_owners AS (
  SELECT CAST(event_id AS VARCHAR) AS token_id,
         CASE event_id % 5 WHEN 0 THEN printf('0x%064x', user_id) WHEN 1 THEN printf('0x%x', user_id)
              WHEN 2 THEN upper(printf('0x%064x', user_id)) WHEN 3 THEN '0x' END AS owner
  FROM events),
decoded AS (
  SELECT id, score,
         {_POSITIONAL} AS reference,
         CASE WHEN regexp_full_match(score, '0x[0-9a-f]{{16}}') THEN CAST('0x' || substr(score, 7, 12) AS BIGINT) END AS strict,
         CASE WHEN regexp_full_match(score, '0x[0-9a-f]{{16}}') THEN CAST(score AS UBIGINT) END AS "full"
  FROM spelt_scores),
np AS (
  SELECT {_NORM.format(c='o.owner')} AS addr_norm, max(o.owner) AS owner
  FROM scoped m JOIN token_owners o ON o.token_id = m.id GROUP BY 1),
e20 AS (SELECT owner AS player, sc, game_no FROM v WHERE n >= 20),
em AS (SELECT player, median(sc) AS e10 FROM e20 WHERE game_no <= 10
       GROUP BY player),
q AS (SELECT player, e10, ntile(4) OVER (ORDER BY e10, player) AS skill_tier FROM em),
persistence AS (
  SELECT CAST(q.skill_tier AS BIGINT) AS skill_tier,
         CAST(CASE WHEN game_no <= 20 THEN 1 WHEN game_no <= 40 THEN 2 WHEN game_no <= 70 THEN 3 ELSE 4 END AS BIGINT) AS later_window,
         count(*) AS games, round(CAST(median(sc) AS DOUBLE), 1) AS median_score
  FROM e20 JOIN q USING (player)
  WHERE game_no > 10 AND game_no <= 120
  GROUP BY 1, 2),
halves AS (
  SELECT owner AS player,
         median(sc) FILTER (WHERE game_no <= n // 2) AS first_med,
         median(sc) FILTER (WHERE game_no > n // 2) AS second_med
  FROM v WHERE n >= 10 GROUP BY owner)
"""


def _q(body: str) -> str:
    return "WITH " + _BASE.strip() + "\n" + body.strip()


def _improvement_sql(table: str, first: str, second: str, first_name: str, second_name: str,
                     uplift: bool = False) -> str:
    extra = ""
    if uplift:
        extra = (f",\n round(100.0::DOUBLE * (avg({second}) / avg({first}) - 1), 1) AS uplift_pct")
    return f"""
SELECT count(*) AS players,
       count(*) FILTER (WHERE {second} > {first}) AS improved,
       round(100.0::DOUBLE * count(*) FILTER (WHERE {second} > {first}) / NULLIF(count(*), 0), 1)
         AS pct_improved,
       round(avg({first}), 1) AS {first_name},
       round(avg({second}), 1) AS {second_name}{extra}
FROM {table} WHERE {first} IS NOT NULL AND {second} IS NOT NULL"""


ORACLE: dict[str, str] = {
    "experience_tiers": _q("""
SELECT experience, count(*) AS games, round(CAST(median(sc) AS DOUBLE), 1) AS median_score
FROM (SELECT CASE WHEN game_no = 1 THEN '1st game' WHEN game_no <= 5 THEN '2nd-5th game'
                  WHEN game_no <= 20 THEN '6th-20th game' WHEN game_no <= 50 THEN '21st-50th game'
                  ELSE '51st+ game' END AS experience, sc FROM v)
GROUP BY experience"""),
    "learning_curve": _q(f"""
SELECT CAST(game_no AS BIGINT) AS game_no, count(*) AS players,
       round(CAST(median(sc) AS DOUBLE), 1) AS median_score
FROM v GROUP BY game_no HAVING count(*) >= 30"""),
    "within_player_improvement": _q(_improvement_sql(
        "halves", "first_med", "second_med", "avg_first_half_median", "avg_second_half_median")),
    "cohort_first_games": _q(f"""
SELECT CASE WHEN owner IN (SELECT addr FROM members) THEN 'og_veteran'
            ELSE 'genuinely_new' END AS cohort,
       count(*) AS first3_games, round(CAST(median(sc) AS DOUBLE), 1) AS median_score_first_3_games
FROM v WHERE game_no <= 3 GROUP BY 1"""),
    "cohort_learning_curve": _q(f"""
SELECT CAST(game_no AS BIGINT) AS game_no, count(*) AS players,
       round(CAST(median(sc) AS DOUBLE), 1) AS median_score
FROM v WHERE (CASE WHEN owner IN (SELECT addr FROM members) THEN 'og_veteran'
                   ELSE 'genuinely_new' END) = 'genuinely_new'
GROUP BY game_no HAVING count(*) >= 30"""),
    "skill_persistence": _q("SELECT * FROM persistence"),
    "distinct_players": _q("SELECT owner FROM np"),
    "landed_mint_players": _q("SELECT count(*) AS mints, count(DISTINCT addr_norm) AS players FROM mp"),
    "duplicate_tokens": _q("""
SELECT g.id, count(*) AS copies
FROM games g JOIN (SELECT token_id FROM token_owners
                   UNION ALL SELECT CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'purchase') o ON o.token_id = g.id
GROUP BY 1 HAVING count(*) > 1"""),
    "mint_event_players": _q("SELECT count(*) AS mints, count(DISTINCT addr_norm) AS players FROM mp"),
    "veteran_overlap": _q("SELECT owner AS addr FROM np WHERE addr_norm IN (SELECT addr_norm FROM mp)"),
    "veteran_overlap_counts": _q("""
SELECT count(*) AS players,
       count(*) FILTER (WHERE addr_norm IN (SELECT addr_norm FROM mp)) AS veterans,
       count(*) - count(*) FILTER (WHERE addr_norm IN (SELECT addr_norm FROM mp)) AS genuinely_new
FROM np"""),
    "cohort_first_games_derived": _q(f"""
SELECT CASE WHEN owner IN (SELECT owner FROM np WHERE addr_norm IN (SELECT addr_norm FROM mp))
            THEN 'og_veteran' ELSE 'genuinely_new' END AS cohort,
       count(*) AS first3_games, round(CAST(median(sc) AS DOUBLE), 1) AS median_score_first_3_games
FROM v WHERE game_no <= 3 GROUP BY 1"""),
    "sequence_load": _q("""
SELECT count(*) AS players, CAST(sum(c) AS BIGINT) AS games, max(c) AS max_games,
       round(max(c) / sum(c), 6) AS max_share
FROM (SELECT owner, count(*) AS c FROM games GROUP BY owner)"""),
    "decode_hex_score": _q(
        "SELECT id, score, CAST('0x' || substr(score, 7, 12) AS BIGINT) AS sc FROM token_scores"),
    "official_games": _q("SELECT id, owner, sc FROM games"),
    "registry_scope": _q(f"""
, reg AS (SELECT printf('0x%016x', s_suppkey) AS idx, printf('0x%064x', s_suppkey) AS address
          FROM supplier)
SELECT s.id, o.owner, CAST('0x' || substr(s.score, 7, 12) AS BIGINT) AS sc
FROM token_metadata m JOIN token_scores s ON s.id = m.id JOIN token_owners o ON o.token_id = m.id
WHERE m.settings_id = 1
  AND m.minted_by IN (SELECT idx FROM reg WHERE address = printf('0x%064x', 6))"""),
    "game_sequence": _q("SELECT owner, id, CAST(game_no AS BIGINT) AS game_no, n FROM seq"),
    "valid_scores": _q("SELECT owner, id, CAST(game_no AS BIGINT) AS game_no, sc FROM v"),
    "grouped_median": _q(f"""
SELECT owner AS player, count(*) AS games, CAST(median(sc) AS DOUBLE) AS median_score
FROM games WHERE sc BETWEEN 1 AND 3000 GROUP BY owner"""),
    "skill_tiers": _q("SELECT player, CAST(e10 AS DOUBLE) AS e10, CAST(skill_tier AS BIGINT) AS skill_tier FROM q"),
    "cohort_tag": _q(f"""
SELECT DISTINCT owner, CASE WHEN owner IN (SELECT addr FROM members) THEN 'og_veteran'
                            ELSE 'genuinely_new' END AS cohort
FROM games"""),
    "normalise_address": _q("""
SELECT block_number, keys[3] AS addr, printf('0x%064x', CAST(keys[3] AS BIGINT)) AS addr_norm
FROM mint_events"""),
    "half_medians": _q("""
SELECT player, CAST(first_med AS DOUBLE) AS first_med, CAST(second_med AS DOUBLE) AS second_med
FROM halves"""),
    "first_k_games": _q(f"""
SELECT owner, id, CAST(game_no AS BIGINT) AS game_no, sc FROM seq WHERE game_no <= 3"""),
    "persistence_correlation": _q(f"""
SELECT count(*) AS players, round(corr(x, y), 6) AS r
FROM (SELECT owner,
             median(sc) FILTER (WHERE game_no <= 10) AS x,
             median(sc) FILTER (WHERE game_no > 10) AS y
      FROM v WHERE n >= 20 GROUP BY owner)
WHERE x IS NOT NULL AND y IS NOT NULL"""),
    "population_summary": _q("""
SELECT count(*) AS games, count(DISTINCT owner) AS players,
       strftime(min(executed_at), '%Y-%m-%d %H:%M:%S.%f') AS first_game,
       strftime(max(executed_at), '%Y-%m-%d %H:%M:%S.%f') AS last_game
FROM v"""),
    "score_distribution": _q("""
SELECT round(quantile_cont(sc, 0.5), 4) AS median_score, round(quantile_cont(sc, 0.99), 4) AS p99_score,
       max(sc) AS max_score, round(avg(sc), 4) AS mean_score
FROM v"""),
    "retention_split": _q(f"""
SELECT CASE WHEN n <= 1 THEN '1 game' WHEN n <= 49 THEN '2-49 games' ELSE '50+ games' END AS retention,
       count(*) AS first3_games, round(CAST(median(sc) AS DOUBLE), 1) AS median_score
FROM v WHERE game_no <= 3 GROUP BY 1"""),
    "lifetime_total_tiers": _q("""
SELECT CASE WHEN n <= 1 THEN '1 game' WHEN n <= 5 THEN '2-5 games' WHEN n <= 20 THEN '6-20 games'
            WHEN n <= 50 THEN '21-50 games' ELSE '51+ games' END AS lifetime,
       count(*) AS games, round(CAST(median(sc) AS DOUBLE), 1) AS median_score
FROM v GROUP BY 1"""),
    "tiers_ordered": _q("""
SELECT later_window, bool_and(prev IS NULL OR median_score >= prev) AS tiers_ordered
FROM (SELECT *, lag(median_score) OVER (PARTITION BY later_window ORDER BY skill_tier) AS prev
      FROM persistence)
GROUP BY later_window"""),
    "key_uniqueness": _q("""
, u AS (
  SELECT 'token_metadata' AS table_name, count(*) AS c FROM token_metadata GROUP BY id
  UNION ALL SELECT 'token_scores', count(*) FROM token_scores GROUP BY id
  UNION ALL SELECT 'token_owners', count(*) FROM token_owners GROUP BY token_id
  UNION ALL SELECT 'lineitem', count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT table_name, CAST(sum(c) AS BIGINT) AS rows, count(*) AS keys,
       count(*) FILTER (WHERE c > 1) AS duplicate_keys
FROM u GROUP BY table_name"""),
    "score_quality": _q(f"""
SELECT CASE WHEN score IS NULL THEN 'null'
            WHEN NOT regexp_full_match(score, '0x[0-9a-f]{{16}}') THEN 'malformed'
            WHEN sc < 1 THEN 'too_small'
            WHEN sc > 3000 THEN 'too_large'
            ELSE 'valid' END AS score_class,
       count(*) AS games
FROM games GROUP BY 1"""),
    "decode_spellings": _q("""
SELECT id, score, CAST(reference AS VARCHAR) AS reference, CAST(strict AS VARCHAR) AS strict,
       CAST("full" AS VARCHAR) AS "full"
FROM decoded"""),
    "score_quality_spellings": _q("""
SELECT CASE WHEN d.score IS NULL THEN 'null'
            WHEN NOT regexp_full_match(d.score, '0x[0-9a-f]{16}') THEN 'malformed'
            WHEN d.reference < 1 THEN 'too_small' WHEN d.reference > 3000 THEN 'too_large'
            ELSE 'valid' END AS score_class,
       count(*) AS games
FROM scoped m JOIN decoded d ON d.id = m.id GROUP BY 1"""),
    "address_quality": _q("""
SELECT CASE WHEN owner IS NULL THEN 'null' WHEN owner = '0x' THEN 'malformed'
            WHEN regexp_full_match(owner, '0x[0-9a-f]{64}') THEN 'canonical' ELSE 'other_spelling' END AS address_class,
       count(*) AS rows
FROM spelt_owners GROUP BY 1"""),
    "distinct_players_spellings": _q(f"""
SELECT {_NORM.format(c='owner')} AS addr_norm, max(owner) AS owner
FROM scoped m JOIN spelt_owners o ON o.token_id = m.id WHERE owner <> '0x' GROUP BY 1"""),
    "skill_persistence_short": _q("""
SELECT CAST(q.skill_tier AS BIGINT) AS skill_tier,
       CAST(CASE WHEN game_no <= 15 THEN 1 WHEN game_no <= 20 THEN 2 WHEN game_no <= 30 THEN 3 ELSE 4 END AS BIGINT) AS later_window,
       count(*) AS games, round(CAST(median(sc) AS DOUBLE), 1) AS median_score
FROM e20 JOIN q USING (player) WHERE game_no > 10 AND game_no <= 50 GROUP BY 1, 2"""),
    "retention_split_short": _q("""
SELECT CASE WHEN n <= 36 THEN 'up to 36' WHEN n <= 44 THEN '37-44' ELSE '45+' END AS retention,
       count(*) AS first3_games, round(CAST(median(sc) AS DOUBLE), 1) AS median_score
FROM v WHERE game_no <= 3 GROUP BY 1"""),
    "lifetime_tiers_short": _q("""
SELECT CASE WHEN n <= 33 THEN 'up to 33' WHEN n <= 37 THEN '34-37' WHEN n <= 41 THEN '38-41'
            WHEN n <= 45 THEN '42-45' ELSE '46+' END AS lifetime,
       count(*) AS games, round(CAST(median(sc) AS DOUBLE), 1) AS median_score
FROM v GROUP BY 1"""),
    "histogram_median": """
SELECT event_type, count(value) AS rows, CAST(median(value) AS DOUBLE) AS median_value
FROM events GROUP BY event_type""",
    "price_medians": """
SELECT l_returnflag, count(l_extendedprice) AS rows, CAST(median(l_extendedprice) AS DOUBLE) AS median_price
FROM lineitem GROUP BY l_returnflag""",
    "price_deciles": """
SELECT l_orderkey, l_linenumber, l_extendedprice,
       CAST(ntile(10) OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS BIGINT) AS decile
FROM lineitem""",
    "latest_event": """
SELECT user_id, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "landed_experience_tiers": _q("""
SELECT CASE WHEN game_no = 1 THEN '1st game' WHEN game_no <= 5 THEN '2nd-5th game'
            WHEN game_no <= 20 THEN '6th-20th game' WHEN game_no <= 50 THEN '21st-50th game'
            ELSE '51st+ game' END AS experience,
       count(*) AS games, round(CAST(median(sc) AS DOUBLE), 1) AS median_score
FROM v GROUP BY 1"""),
    "landed_counts": _q("""
SELECT 'metadata' AS item, count(*) AS rows FROM token_metadata
UNION ALL SELECT 'scores', count(*) FROM token_scores
UNION ALL SELECT 'owners', count(*) FROM token_owners
UNION ALL SELECT 'games', count(*) FROM games
UNION ALL SELECT 'members', count(DISTINCT addr) FROM members
UNION ALL SELECT 'members_array', count(DISTINCT addr) FROM members
UNION ALL SELECT 'mints', count(*) FROM mp
UNION ALL SELECT 'players', count(DISTINCT addr_norm) FROM mp"""),
}

# A body starting with ", name AS (...)" adds CTEs after the shared ones.
ORACLE["early_vs_later_improvement"] = _q(
    """
, p AS (SELECT owner,
              median(sc) FILTER (WHERE game_no <= 50) AS early_med,
              median(sc) FILTER (WHERE game_no > 50) AS later_med
       FROM v WHERE n > 50 GROUP BY owner)
""" + _improvement_sql("p", "early_med", "later_med", "avg_early_median", "avg_later_median",
                       uplift=True))

# The same reports over the stored games.
ORACLE["half_medians_shared"] = ORACLE["half_medians"]
ORACLE["skill_persistence_shared"] = ORACLE["skill_persistence"]
