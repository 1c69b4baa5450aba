"""SQL building blocks for the DuckDB oracles (the same stand-in mapping as
``sources.driver_tables``, written independently in SQL)."""

YEAR = "CAST(year(l_shipdate) AS INTEGER)"

PERF = f"""perf AS (
  SELECT l_partkey AS player,
    CASE WHEN l_linenumber = 7 THEN '2TM' ELSE 'S' || CAST(l_suppkey AS VARCHAR) END AS team,
    {YEAR} AS season_end_year,
    CAST({YEAR} - 1 AS VARCHAR) || '-' || CAST({YEAR} AS VARCHAR) AS season,
    CASE l_linenumber WHEN 1 THEN 'PG' WHEN 2 THEN ' sg ' WHEN 3 THEN 'SF' WHEN 4 THEN 'PF'
      WHEN 5 THEN 'C' WHEN 6 THEN 'PG-SG' WHEN 7 THEN 'G-F' END AS pos,
    CASE WHEN l_extendedprice > 85000 THEN 'MVP-2,AS,NBA1' WHEN l_extendedprice > 75000 THEN 'AS'
      WHEN l_linenumber = 6 THEN 'DPOY-4' END AS awards,
    CAST(l_linenumber + 1 AS DOUBLE) AS g,
    CAST(l_linenumber AS DOUBLE) AS gs,
    l_quantity * CAST(60 AS DOUBLE) AS mp,
    l_quantity * (CAST(1 AS DOUBLE) - l_discount) AS fg,
    l_quantity AS fga,
    l_quantity * l_tax AS p3,
    l_quantity * CAST(0.3 AS DOUBLE) AS p3a,
    l_quantity * (CAST(1 AS DOUBLE) - l_discount) - l_quantity * l_tax AS p2,
    l_quantity - l_quantity * CAST(0.3 AS DOUBLE) AS p2a,
    l_quantity * l_discount * (CAST(1 AS DOUBLE) - l_tax) AS ft,
    l_quantity * l_discount AS fta,
    CAST(l_linenumber AS DOUBLE) AS orb,
    l_quantity / CAST(5 AS DOUBLE) AS drb,
    CAST(l_linenumber AS DOUBLE) + l_quantity / CAST(5 AS DOUBLE) AS trb,
    l_quantity * l_tax AS ast,
    l_discount * CAST(100 AS DOUBLE) AS stl,
    l_tax * CAST(100 AS DOUBLE) AS blk,
    CAST(l_linenumber AS DOUBLE) AS tov,
    CAST(l_linenumber AS DOUBLE) AS pf,
    l_extendedprice AS pts,
    CASE WHEN l_linenumber = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS trp_dbl,
    l_partkey AS pk
  FROM lineitem)"""

PERF_AGE = PERF + """,
perf_age AS (
  SELECT perf.*, CAST(p_size AS DOUBLE) AS age FROM perf JOIN part ON perf.pk = part.p_partkey)"""

OUTCOME = f"""outcome AS (
  SELECT CASE WHEN l_suppkey % 10 = 3 AND {YEAR} < 1998 THEN 'X' || CAST(l_suppkey AS VARCHAR)
              ELSE 'S' || CAST(l_suppkey AS VARCHAR) END AS team,
         {YEAR} AS season_end_year,
         CAST({YEAR} - 1 AS VARCHAR) || '-' || CAST({YEAR} AS VARCHAR) AS season,
         CAST(count(*) FILTER (WHERE l_returnflag <> 'R') AS INTEGER) AS wins,
         CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS INTEGER) AS losses
  FROM lineitem GROUP BY l_suppkey, {YEAR})"""

TEAM_SUMS = ("fg", "fga", "p3", "p3a", "p2", "p2a", "ft", "fta", "orb", "drb", "trb",
             "ast", "stl", "blk", "tov", "pf", "pts", "trp_dbl")

TOTALS = """totals AS (
  SELECT season, season_end_year, team, """ + ", ".join(
    f"coalesce(sum({m}), 0.0) AS {m}" for m in TEAM_SUMS) + """
  FROM perf
  WHERE coalesce(team NOT IN ('2TM', '3TM', '4TM', '5TM'), true)
    AND season IS NOT NULL AND season_end_year IS NOT NULL AND team IS NOT NULL
  GROUP BY season, season_end_year, team)"""

TEAM_SEASON = TOTALS + """,
team_season AS (
  SELECT t.*,
    coalesce(fg / NULLIF(fga, 0), 0.0) AS fg_pct,
    coalesce(p3 / NULLIF(p3a, 0), 0.0) AS p3_pct,
    coalesce(p2 / NULLIF(p2a, 0), 0.0) AS p2_pct,
    coalesce(ft / NULLIF(fta, 0), 0.0) AS ft_pct,
    coalesce((fg + 0.5 * p3) / NULLIF(fga, 0), 0.0) AS efg_pct,
    o.wins, o.losses
  FROM totals t LEFT JOIN outcome o ON t.season_end_year = o.season_end_year AND t.team = o.team)"""


def r6(expr: str, alias: str, digits: int = 6) -> str:
    """The oracle side of ``out_round``."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {alias}"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
