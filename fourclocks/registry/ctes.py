"""SQL text of the domain views, shared by the SQL counterparts."""

AMOUNTS = """
poll_amounts AS (
  SELECT l_orderkey AS poll_id,
         sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS qa,
         sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS qn,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS qr,
         sum(l_quantity) AS sample_size, count(*) AS line_count
  FROM lineitem GROUP BY 1)"""

POLLS = AMOUNTS + """,
poll_headers AS (
  SELECT o_orderkey AS poll_id, c_nationkey AS election_id, o_custkey AS pollster,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'live_phone' WHEN '2-HIGH' THEN 'mixed'
              WHEN '3-MEDIUM' THEN 'online' WHEN '4-NOT SPECIFIED' THEN 'ivr' ELSE 'unknown' END AS mode,
         CAST(o_orderdate AS DATE) AS fieldwork_end,
         CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 14 AS INTEGER) AS TIMESTAMP) AS available_at,
         c_mktsegment AS sponsor, o_orderpriority AS scenario_id
  FROM orders JOIN customer ON o_custkey = c_custkey),
polls AS (
  SELECT h.*, sample_size, line_count, qa / sample_size AS sa, qn / sample_size AS sn, qr / sample_size AS sr
  FROM poll_headers h JOIN poll_amounts USING (poll_id))"""

RESULTS = """
poll_results AS (
  SELECT l_orderkey AS poll_id, l_returnflag AS contestant_id,
         sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_orderkey) AS share
  FROM lineitem GROUP BY 1, 2)"""

OBS = """
observations AS (
  SELECT event_id AS revision_id, user_id AS jurisdiction_id, event_type AS metric, value,
         date_trunc('day', ts) AS observed_at, ts AS available_at,
         ts + CAST(event_id % 60 AS INTEGER) * INTERVAL 1 MINUTE AS retrieved_at,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS revision
  FROM events)"""

FEED = """
feed AS (
  SELECT event_id, user_id AS unit_id, event_type AS contestant_id,
         CAST(floor(value) AS BIGINT) AS votes,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts AS reported_at
  FROM events)"""

RUNS = """
runs AS (
  SELECT event_id, event_type AS job, user_id % 10 AS scope, ts AS occurred_at,
         CASE WHEN value < 5 THEN 'failure' ELSE 'success' END AS status, value, user_id
  FROM events)"""

VOTES = """
votes AS (
  SELECT c_nationkey AS contest_id, c_mktsegment AS party, CAST(count(*) AS BIGINT) AS votes,
         c_nationkey + 10 AS seats,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2
              WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 ELSE 5 END AS party_index
  FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)"""

DRAWS = POLLS + """,
long_draws AS (
  SELECT poll_id AS run_id, election_id, scenario_id, seats_total, u.c AS contestant_id, u.i AS idx, u.s AS share,
         sample_size / (line_count * 50.0) AS turnout, u.s / ((sa + sn) + sr) * seats_total AS quota
  FROM (SELECT p.*, election_id + 10 AS seats_total,
               unnest([{'c': 'A', 'i': 0, 's': sa}, {'c': 'N', 'i': 1, 's': sn}, {'c': 'R', 'i': 2, 's': sr}]) AS u
        FROM polls p)),
draws AS (
  SELECT *, CAST(floor(quota) AS INTEGER)
           + CASE WHEN row_number() OVER (PARTITION BY run_id ORDER BY quota - floor(quota) DESC, idx)
                       <= seats_total - sum(floor(quota)) OVER (PARTITION BY run_id) THEN 1 ELSE 0 END AS seats,
         CAST(floor(seats_total / 2) AS INTEGER) + 1 AS majority
  FROM long_draws),
won AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seats DESC, idx) = 1 AS is_win FROM draws)"""
