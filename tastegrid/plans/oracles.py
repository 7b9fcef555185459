"""The queries again as plain SQL over the fixture tables."""

from __future__ import annotations

K, NEIGHBORS, HISTORY, SEED, PARTS, FACTORS = 20, 100, 20, 2026, 4, 4


def _code(text: str) -> str:
    """A 60-bit number from a text."""
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def _drawn(text: str) -> str:
    """A number from -0.5 to 0.5 from a text."""
    return f"({_code(text)} / {float(1 << 60)!r} - 0.5)"


def _layer(name: str, inputs: str, width_in: int, width_out: int) -> str:
    """The outputs of a dense layer with drawn weights."""
    column = "[" + ", ".join(_drawn(f"concat('{name}:{row}:', c)") for row in range(width_in)) + "]"
    cell = f"list_dot_product({inputs}, {column}) + " + _drawn(f"concat('{name}:b:', c)")
    return f"[{cell} FOR c IN range({width_out})]"


def _relu(values: str) -> str:
    return f"[greatest(x, 0.0) FOR x IN {values}]"


def _vector(kind: str, key: str, width: int) -> str:
    return f"[{_drawn(f"concat('{kind}:', {key}, ':', p)")} FOR p IN range({width})]"


def _unit(source: str, key: str) -> str:
    """Lists `raw` divided by their length."""
    return f"""SELECT {key}, [x / greatest(sqrt(list_dot_product(raw, raw)), 1e-12) FOR x IN raw] AS v FROM ({source})"""


def _tower(side: str, inputs: str, joined: int) -> str:
    hidden = _relu(_layer(f"{side}_hidden", inputs, joined, 4))
    return _layer(f"{side}_out", hidden, 4, 3)


def _bpr_epoch() -> str:
    """An epoch of turns, each a step from the vectors of the last."""
    sql = _negatives() + f"""
        , rows AS (
            SELECT user_id, item_id, negative_id,
                   (part - {_code("CAST(user_id AS VARCHAR)")} % {PARTS} + {PARTS}) % {PARTS} AS turn FROM negatives),
        s0 AS (
            SELECT kind, key, d, {_drawn("concat(kind, ':', key, ':', d)")} AS v
            FROM (SELECT DISTINCT 'user' AS kind, user_id AS key FROM seen UNION ALL SELECT 'item', item_id FROM items),
                 (SELECT unnest(range({FACTORS})) AS d))"""
    for turn in range(PARTS):
        sql += f"""
        , x{turn} AS (
            SELECT r.user_id, r.item_id, r.negative_id, u.d, u.v AS u, i.v AS i, j.v AS j,
                   sum(u.v * (i.v - j.v)) OVER (PARTITION BY r.user_id, r.item_id) AS margin
            FROM rows r JOIN s{turn} u ON u.kind = 'user' AND u.key = r.user_id
            JOIN s{turn} i ON i.kind = 'item' AND i.key = r.item_id AND i.d = u.d
            JOIN s{turn} j ON j.kind = 'item' AND j.key = r.negative_id AND j.d = u.d
            WHERE r.turn = {turn}),
        c{turn} AS (
            SELECT 'user' AS kind, user_id AS key, d, 0.05 * ((i - j) / (1 + exp(margin)) - 0.01 * u) AS c FROM x{turn}
            UNION ALL SELECT 'item', item_id, d, 0.05 * (u / (1 + exp(margin)) - 0.01 * i) FROM x{turn}
            UNION ALL SELECT 'item', negative_id, d, 0.05 * (-u / (1 + exp(margin)) - 0.01 * j) FROM x{turn}),
        s{turn + 1} AS (
            SELECT s.kind, s.key, s.d, s.v + coalesce(t.c, 0.0) AS v FROM s{turn} s
            LEFT JOIN (SELECT kind, key, d, sum(c) AS c FROM c{turn} GROUP BY kind, key, d) t
                 ON t.kind = s.kind AND t.key = s.key AND t.d = s.d)"""
    losses = " UNION ALL ".join(f"SELECT ln(1 + exp(-margin)) AS loss FROM x{turn} WHERE d = 0" for turn in range(PARTS))
    return sql + f"""
        SELECT kind, CAST(key AS VARCHAR) AS key, CAST(d AS INTEGER) AS place, round(v, 6) AS value FROM s{PARTS}
        UNION ALL SELECT 'stat', 'loss:0', CAST(0 AS INTEGER), round(avg(loss), 6) FROM ({losses})"""

# Named parts; each lists the parts it reads.
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "log": ((), """
        SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS event_time,
               CAST(l_returnflag <> 'R' AS INTEGER) AS label,
               l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_linestatus
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "train": (("log",), "SELECT * FROM log WHERE event_time < TIMESTAMP '1999-01-01'"),
    "future": (("log",), "SELECT * FROM log WHERE event_time >= TIMESTAMP '1998-12-25'"),
    "audit": (("future",), "SELECT * FROM future WHERE l_linestatus = 'O'"),
    "strict": (("future", "train"), """
        SELECT * FROM future WHERE event_time > (SELECT max(event_time) FROM train)"""),
    "numbered": (("strict",), """
        SELECT *, count(*) OVER () AS n, row_number() OVER (
            ORDER BY event_time, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rn
        FROM (SELECT *, item_id AS l_partkey FROM strict)"""),
    "validation": (("numbered",), """
        SELECT * FROM numbered WHERE rn <= greatest(least(floor(n * 0.5), n - 1), 1)"""),
    "test": (("numbered",), """
        SELECT * FROM numbered WHERE rn > greatest(least(floor(n * 0.5), n - 1), 1)"""),
    "stacked": (("train", "validation", "test", "audit"), """
        SELECT 'train' AS split, user_id, item_id, event_time, label FROM train
        UNION ALL SELECT 'validation', user_id, item_id, event_time, label FROM validation
        UNION ALL SELECT 'test', user_id, item_id, event_time, label FROM test
        UNION ALL SELECT 'random_audit', user_id, item_id, event_time, label FROM audit"""),
    "seen": (("train",), "SELECT DISTINCT user_id, item_id FROM train WHERE label > 0"),
    "items": (("train",), "SELECT DISTINCT item_id FROM train"),
    "popularity": (("items", "seen"), """
        SELECT i.item_id, count(s.user_id) AS popularity
        FROM items i LEFT JOIN seen s ON i.item_id = s.item_id GROUP BY i.item_id"""),
    "activity": (("seen",), "SELECT user_id, count(*) AS n_items FROM seen GROUP BY user_id"),
    "truth_validation": (("validation", "items", "seen"), """
        SELECT DISTINCT v.user_id, v.item_id FROM validation v
        WHERE v.label > 0 AND v.item_id IN (SELECT item_id FROM items)
          AND NOT EXISTS (SELECT 1 FROM seen s
                          WHERE s.user_id = v.user_id AND s.item_id = v.item_id)"""),
    "truth_test": (("test", "items", "seen"), """
        SELECT DISTINCT v.user_id, v.item_id FROM test v
        WHERE v.label > 0 AND v.item_id IN (SELECT item_id FROM items)
          AND NOT EXISTS (SELECT 1 FROM seen s
                          WHERE s.user_id = v.user_id AND s.item_id = v.item_id)"""),
    "truth": (("truth_validation", "truth_test"), """
        SELECT 'validation' AS split, * FROM truth_validation
        UNION ALL SELECT 'test', * FROM truth_test"""),
    "customers": (("log",), "SELECT DISTINCT user_id FROM log"),
    "popular": (("customers", "popularity", "seen"), f"""
        SELECT * FROM (
            SELECT c.user_id, p.item_id, p.popularity, row_number() OVER (
                PARTITION BY c.user_id
                ORDER BY p.popularity DESC, CAST(p.item_id AS VARCHAR)) AS rank
            FROM customers c CROSS JOIN popularity p
            ANTI JOIN seen s ON s.user_id = c.user_id AND s.item_id = p.item_id)
        WHERE rank <= {K}"""),
    "pair_counts": (("seen",), """
        SELECT a.item_id, b.item_id AS neighbor_id, count(*) AS co_count
        FROM seen a JOIN seen b ON a.user_id = b.user_id AND a.item_id <> b.item_id
        GROUP BY a.item_id, b.item_id"""),
    "neighbors": (("pair_counts", "popularity"), f"""
        SELECT * FROM (
            SELECT c.item_id, c.neighbor_id, c.co_count,
                   least(greatest(c.co_count / sqrt(x.popularity * y.popularity), 0.0), 1.0) AS similarity,
                   row_number() OVER (PARTITION BY c.item_id
                       ORDER BY CAST(c.co_count * c.co_count AS DOUBLE) / y.popularity DESC,
                                y.popularity DESC, CAST(c.neighbor_id AS VARCHAR)) AS rank
            FROM pair_counts c
            JOIN popularity x ON x.item_id = c.item_id
            JOIN popularity y ON y.item_id = c.neighbor_id)
        WHERE rank <= {NEIGHBORS}"""),
    "cf_scores": (("seen", "neighbors"), """
        SELECT s.user_id, n.neighbor_id AS item_id, sum(n.similarity) AS score
        FROM seen s JOIN neighbors n ON n.item_id = s.item_id
        GROUP BY s.user_id, n.neighbor_id"""),
    "cf": (("customers", "popularity", "seen", "cf_scores"), f"""
        SELECT * FROM (
            SELECT c.user_id, p.item_id, coalesce(f.score, 0.0) AS score,
                   row_number() OVER (PARTITION BY c.user_id
                       ORDER BY round(coalesce(f.score, 0.0), 9) DESC, p.popularity DESC,
                                CAST(p.item_id AS VARCHAR)) AS rank
            FROM customers c CROSS JOIN popularity p
            LEFT JOIN cf_scores f ON f.user_id = c.user_id AND f.item_id = p.item_id
            ANTI JOIN seen s ON s.user_id = c.user_id AND s.item_id = p.item_id)
        WHERE rank <= {K}"""),
    "ks": ((), "SELECT unnest([5, 10, 20]) AS k"),
    "per_user": (("truth", "recs", "ks"), """
        SELECT t.model, t.split, t.k, t.user_id, t.n_hits / t.n_relevant AS recall,
               CAST(t.n_hits > 0 AS DOUBLE) AS hit_rate,
               t.gain / list_sum([1 / log2(r + 1) FOR r IN range(1, least(t.n_relevant, t.k) + 1)]) AS ndcg
        FROM (
            SELECT m.model, t.split, ks.k, t.user_id, count(*) AS n_relevant,
                   count(r.item_id) AS n_hits, coalesce(sum(1 / log2(r.rank + 1)), 0.0) AS gain
            FROM truth t CROSS JOIN ks CROSS JOIN (SELECT unnest(['popularity', 'itemcf']) AS model) m
            LEFT JOIN recs r ON r.model = m.model AND r.user_id = t.user_id
                 AND r.item_id = t.item_id AND r.rank <= ks.k
            GROUP BY m.model, t.split, ks.k, t.user_id) t"""),
    "recs": (("popular", "cf"), """
        SELECT 'popularity' AS model, user_id, item_id, rank FROM popular
        UNION ALL SELECT 'itemcf', user_id, item_id, rank FROM cf"""),
    "shown": (("recs", "truth", "ks"), """
        SELECT r.model, t.split, ks.k, r.user_id, r.item_id
        FROM recs r JOIN (SELECT DISTINCT split, user_id FROM truth) t ON t.user_id = r.user_id
        JOIN ks ON r.rank <= ks.k"""),
    "covered": (("shown", "items"), """
        SELECT model, split, k,
               count(DISTINCT item_id) / (SELECT count(*) FROM items) AS coverage
        FROM shown GROUP BY model, split, k"""),
    "overall": (("per_user", "covered"), """
        SELECT p.model, p.split, CAST(p.k AS INTEGER) AS k, round(avg(recall), 6) AS recall,
               round(avg(hit_rate), 6) AS hit_rate, round(avg(ndcg), 6) AS ndcg,
               round(any_value(c.coverage), 6) AS coverage, count(*) AS evaluated_users
        FROM per_user p JOIN covered c ON c.model = p.model AND c.split = p.split AND c.k = p.k
        GROUP BY p.model, p.split, p.k"""),
    "user_groups": (("activity",), """
        SELECT user_id, CASE
            WHEN n_items <= (SELECT round(quantile_cont(n_items, 1.0 / 3), 9) FROM activity) THEN 'low'
            WHEN n_items <= (SELECT round(quantile_cont(n_items, 2.0 / 3), 9) FROM activity) THEN 'medium'
            ELSE 'high' END AS segment
        FROM activity"""),
    "item_groups": (("popularity",), """
        SELECT item_id, CASE
            WHEN popularity <= (SELECT round(quantile_cont(popularity, 0.5), 9) FROM popularity) THEN 'tail'
            WHEN popularity <= (SELECT round(quantile_cont(popularity, 0.8), 9) FROM popularity) THEN 'mid'
            ELSE 'head' END AS segment
        FROM popularity"""),
    "customer_table": ((), """
        SELECT c_custkey AS user_id, nullif(c_mktsegment, 'HOUSEHOLD') AS segment,
               c_nationkey AS nation, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance
        FROM customer"""),
    "attached": (("customers", "customer_table"), """
        SELECT u.user_id, t.segment, t.nation, t.balance
        FROM customers u LEFT JOIN customer_table t ON t.user_id = u.user_id"""),
    # Features and vectors of a small tower; widths 3 (ids), 4 (hidden), 2 (features).
    "user_cells": (("learned", "customer_table"), """
        SELECT u.user_id, coalesce(c.segment, '__MISSING__') AS a, coalesce(CAST(c.nation AS VARCHAR), '__MISSING__') AS b,
               c.balance AS x
        FROM (SELECT DISTINCT user_id FROM learned) u LEFT JOIN customer_table c ON c.user_id = u.user_id"""),
    "item_cells": (("items",), """
        SELECT i.item_id, coalesce(p_brand, '__MISSING__') AS a, coalesce(p_type, '__MISSING__') AS b,
               CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y
        FROM items i LEFT JOIN part ON p_partkey = i.item_id"""),
    "learned": (("train",), "SELECT * FROM train"),
    "item_tower": (("item_cells",), f"""
        SELECT item_id, v FROM (
        {_unit("SELECT item_id, " + _tower("item", "list_concat(" + _vector("item", "item_id", 3) + ", projected)", 5) + """ AS raw
            FROM (SELECT item_id, """ + _relu(_layer("item_proj", "flat", 6, 2)) + """ AS projected
                FROM (SELECT item_id, list_concat(list_concat(""" + _vector("item_feature", "ea", 2) + ", " + _vector("item_feature", "eb", 2) + """), [sx, sy]) AS flat
                    FROM (SELECT item_id, dense_rank() OVER (ORDER BY a) - 1 AS ea,
                                 (SELECT count(DISTINCT a) FROM item_cells) + dense_rank() OVER (ORDER BY b) - 1 AS eb,
                                 (lx - avg(lx) OVER ()) / stddev_pop(lx) OVER () AS sx,
                                 (ly - avg(ly) OVER ()) / stddev_pop(ly) OVER () AS sy
                        FROM (SELECT *, sign(x) * ln(1 + abs(x)) AS lx, sign(y) * ln(1 + abs(y)) AS ly
                            FROM (SELECT item_id, a, b, coalesce(x, median(x) OVER ()) AS x,
                                         coalesce(y, median(y) OVER ()) AS y FROM item_cells)))))""", "item_id")})"""),
    "user_projected": (("user_cells",), f"""
        SELECT user_id, {_relu(_layer("user_proj", "flat", 5, 2))} AS projected
        FROM (SELECT user_id, list_concat(list_concat({_vector("user_feature", "ea", 2)}, {_vector("user_feature", "eb", 2)}), [sx]) AS flat
            FROM (SELECT user_id, dense_rank() OVER (ORDER BY a) - 1 AS ea,
                         (SELECT count(DISTINCT a) FROM user_cells) + dense_rank() OVER (ORDER BY b) - 1 AS eb,
                         (lx - avg(lx) OVER ()) / stddev_pop(lx) OVER () AS sx
                FROM (SELECT *, sign(x) * ln(1 + abs(x)) AS lx
                    FROM (SELECT user_id, a, b, coalesce(x, median(x) OVER ()) AS x FROM user_cells))))"""),
    "histories": (("firsts",), f"""
        SELECT user_id, item_id, nth, list(item_id) OVER (PARTITION BY user_id ORDER BY nth
                   ROWS BETWEEN {HISTORY} PRECEDING AND 1 PRECEDING) AS before,
               list(item_id) OVER (PARTITION BY user_id ORDER BY nth
                   ROWS BETWEEN {HISTORY - 1} PRECEDING AND CURRENT ROW) AS upto,
               count(*) OVER (PARTITION BY user_id) AS n
        FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id
                  ORDER BY event_time, l_orderkey, l_linenumber, item_id, l_suppkey, l_shipdate) AS nth FROM firsts)"""),
    "asked": (("histories",), """
        SELECT user_id, item_id, coalesce(before, []) AS history FROM histories
        UNION ALL SELECT user_id, NULL, upto FROM histories WHERE nth = n"""),
    "history_means": (("asked", "item_tower"), """
        SELECT a.user_id, a.item_id, [coalesce(p0, 0.0), coalesce(p1, 0.0), coalesce(p2, 0.0)] AS history
        FROM asked a LEFT JOIN (
            SELECT h.user_id, h.item_id, avg(t.v[1]) AS p0, avg(t.v[2]) AS p1, avg(t.v[3]) AS p2
            FROM (SELECT user_id, item_id, unnest(history) AS met FROM asked) h JOIN item_tower t ON t.item_id = h.met
            GROUP BY h.user_id, h.item_id) m ON m.user_id = a.user_id AND m.item_id IS NOT DISTINCT FROM a.item_id"""),
    "user_tower": (("history_means", "user_projected"), f"""
        SELECT user_id, item_id, v FROM (
        {_unit("SELECT q.user_id, q.item_id, " + _tower("user", "list_concat(list_concat(" + _vector("user", "q.user_id", 3) + ", q.history), f.projected)", 8) + """ AS raw
            FROM history_means q JOIN user_projected f ON f.user_id = q.user_id""", "user_id, item_id")})"""),
    "sold": (("log",), """
        SELECT i.item_id, p_brand AS brand, p_type AS kind,
               CASE WHEN i.item_id % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS size,
               CAST(p_retailprice AS DOUBLE) AS price
        FROM (SELECT DISTINCT item_id FROM log) i LEFT JOIN part ON p_partkey = i.item_id"""),
    "firsts": (("train",), """
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, item_id
                ORDER BY event_time, l_orderkey, l_linenumber, l_suppkey, l_shipdate) AS nth
            FROM train WHERE label > 0)
        WHERE nth = 1"""),
    "click_log": ((), """
        SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
               ts AS event_time, CAST(event_type = 'click' AS INTEGER) AS label, event_id, value
        FROM events"""),
    "clicks": (("click_log",), "SELECT DISTINCT user_id, item_id FROM click_log WHERE label > 0"),
    "recent_clicks": (("click_log",), f"""
        SELECT user_id, item_id FROM (
            SELECT user_id, item_id, row_number() OVER (
                PARTITION BY user_id ORDER BY event_time DESC, event_id DESC) AS back
            FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id
                      ORDER BY event_time, event_id) AS nth FROM click_log WHERE label > 0)
            WHERE nth = 1)
        WHERE back <= {HISTORY}"""),
    "pooled": (("recent_clicks",), """
        SELECT user_id, dimension, avg(value) AS value FROM (
            SELECT r.user_id, unnest(range(64)) AS dimension,
                   unnest(CAST(e.embedding AS DOUBLE[])) AS value
            FROM recent_clicks r JOIN embeddings e ON e.vec_id = r.item_id)
        GROUP BY user_id, dimension"""),
    "click_train": (("click_log",), """
        SELECT * FROM click_log WHERE event_time < TIMESTAMP '2024-01-19'"""),
}


def _with(needed: tuple[str, ...], body: str) -> str:
    """Put the needed parts, in reading order, in front of the statement."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in _PARTS[name][0]:
            visit(other)
        ordered.append(name)

    for name in needed:
        visit(name)
    ctes = ",\n".join(f"{name} AS ({_PARTS[name][1]})" for name in ordered)
    return f"WITH {ctes}\n{body}"


def _negatives() -> str:
    """The first unseen one of forty drawn items of the part of each pair's item."""
    return _with(("seen", "items"), f"""
        , parted AS (
            SELECT item_id, CAST({_code("concat(item_id, ':0')")} % {PARTS} AS INTEGER) AS part FROM items),
        positions AS (
            SELECT item_id, part, row_number() OVER (PARTITION BY part ORDER BY item_id) - 1 AS position,
                   count(*) OVER (PARTITION BY part) AS size FROM parted),
        tries AS (
            SELECT s.user_id, s.item_id, p.part, a.attempt,
                   {_code(f"concat(s.user_id, ':', s.item_id, ':{SEED}:0:', a.attempt)")} % p.size AS position
            FROM seen s JOIN positions p USING (item_id) CROSS JOIN (SELECT unnest(range(40)) AS attempt) a),
        negatives AS (
            SELECT t.user_id, t.item_id, t.part, arg_min(p.item_id, t.attempt) AS negative_id
            FROM tries t JOIN positions p ON p.part = t.part AND p.position = t.position
            ANTI JOIN seen s ON s.user_id = t.user_id AND s.item_id = p.item_id
            GROUP BY t.user_id, t.item_id, t.part)""").replace("\n\n        , parted", ", parted")


# Item neighbors of the click log, whole or of its history.
def _click_cf(log: str, neighbor_k: int) -> str:
    return f"""
    WITH click_log AS ({_PARTS["click_log"][1]}),
    click_train AS ({_PARTS["click_train"][1]}),
    seen AS (SELECT DISTINCT user_id, item_id FROM {log} WHERE label > 0),
    items AS (SELECT DISTINCT item_id FROM {log}),
    popularity AS ({_PARTS["popularity"][1]}),
    pair_counts AS ({_PARTS["pair_counts"][1]}),
    neighbors AS ({_PARTS["neighbors"][1].replace(f"rank <= {NEIGHBORS}", f"rank <= {neighbor_k}")}),
    cf_scores AS ({_PARTS["cf_scores"][1]}),
    customers AS (SELECT DISTINCT user_id FROM {log}),
    cf AS ({_PARTS["cf"][1]})"""


def oracle_queries() -> dict[str, str]:
    split_columns = "user_id, item_id, CAST(event_time AS VARCHAR) AS event_time, label, l_orderkey, l_linenumber"
    metrics = "round(avg(recall), 6) AS recall, round(avg(hit_rate), 6) AS hit_rate, round(avg(ndcg), 6) AS ndcg"
    one = "p.model = 'popularity' AND p.split = 'validation' AND p.k = 20"
    return {
        "read_log": _with(("click_log",), """
            SELECT user_id, item_id, epoch_us(event_time) AS event_time, label, event_id
            FROM click_log"""),
        "load_logs": _with(("train", "future", "audit"), """
            SELECT log, user_id, item_id, epoch_us(event_time) AS event_time, label,
                   l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey
            FROM (SELECT 'history' AS log, * FROM train
                  UNION ALL SELECT 'future', * FROM future
                  UNION ALL SELECT 'random_audit', * FROM audit)"""),
        "prepare": _with(("train", "strict", "audit"), """
            SELECT split, count(*) AS interactions, count(DISTINCT user_id) AS users,
                   count(DISTINCT item_id) AS items, epoch_us(min(event_time)) AS start_time,
                   epoch_us(max(event_time)) AS end_time, round(avg(label), 6) AS positive_rate,
                   count(*) AS rows_read, CAST(sum(label) AS BIGINT) AS positives_read
            FROM (SELECT 'train' AS split, user_id, item_id, event_time, label FROM train
                  UNION ALL SELECT 'random_audit', user_id, item_id, event_time, label FROM audit
                  UNION ALL
                  SELECT CASE WHEN rn <= greatest(least(floor(n * 0.5), n - 1), 1) THEN 'validation' ELSE 'test' END,
                         user_id, item_id, event_time, label
                  FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (
                            ORDER BY event_time, CAST(user_id AS VARCHAR), CAST(item_id AS VARCHAR), label,
                                     CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                                     CAST(l_suppkey AS VARCHAR)) AS rn
                        FROM strict))
            GROUP BY split"""),
        "load_features": _with(("customer_table",), """
            SELECT 'user' AS side, user_id AS id, f.feature, f.value, f.number FROM customer_table,
                 LATERAL (SELECT unnest(['segment', 'nation', 'balance']) AS feature,
                                 unnest([segment, CAST(nation AS VARCHAR), NULL]) AS value,
                                 unnest([NULL, NULL, balance]) AS number) f
            UNION ALL
            SELECT 'item', p_partkey, f.feature, f.value, f.number FROM part,
                 LATERAL (SELECT unnest(['brand', 'kind', 'size', 'price']) AS feature,
                                 unnest([p_brand, p_type, NULL, NULL]) AS value,
                                 unnest([NULL, NULL, CAST(p_size AS DOUBLE), CAST(p_retailprice AS DOUBLE)]) AS number) f"""),
        "splits_csv_roundtrip": _with(("train", "validation", "test", "audit"), """
            SELECT split, user_id, item_id, CAST(event_time AS VARCHAR) AS event_time, label,
                   l_orderkey, l_linenumber, l_suppkey
            FROM (SELECT 'train' AS split, user_id, item_id, event_time, label, l_orderkey, l_linenumber, l_suppkey FROM train
                  UNION ALL SELECT 'validation', user_id, item_id, event_time, label, l_orderkey, l_linenumber, l_suppkey FROM validation
                  UNION ALL SELECT 'test', user_id, item_id, event_time, label, l_orderkey, l_linenumber, l_suppkey FROM test
                  UNION ALL SELECT 'random_audit', user_id, item_id, event_time, label, l_orderkey, l_linenumber, l_suppkey FROM audit)"""),
        "split_roundtrip": _with(("stacked",), """
            SELECT split, user_id, item_id, CAST(event_time AS VARCHAR) AS event_time, label FROM stacked"""),
        "positives": _with(("log",), """
            SELECT user_id, item_id, CAST(event_time AS VARCHAR) AS event_time, label FROM log WHERE label > 0"""),
        "strict_future": _with(("strict",), """
            SELECT user_id, item_id, CAST(event_time AS VARCHAR) AS event_time, label FROM strict"""),
        "positive_pairs": _with(("log",), "SELECT DISTINCT user_id, item_id FROM log WHERE label > 0"),
        "first_positive": _with(("log",), """
            SELECT user_id, item_id, CAST(event_time AS VARCHAR) AS event_time, l_orderkey, l_linenumber FROM (
                SELECT *, row_number() OVER (PARTITION BY user_id, item_id
                    ORDER BY event_time, l_orderkey, l_linenumber, l_suppkey, l_shipdate) AS nth
                FROM log WHERE label > 0)
            WHERE nth = 1"""),
        "catalog": _with(("items",), "SELECT item_id FROM items"),
        "id_map": _with(("log",), """
            SELECT item_id, row_number() OVER (
                ORDER BY event_time, l_orderkey, l_linenumber, item_id, l_suppkey, l_shipdate) - 1 AS index
            FROM (SELECT *, row_number() OVER (PARTITION BY item_id
                ORDER BY event_time, l_orderkey, l_linenumber, l_suppkey, l_shipdate) AS nth FROM log)
            WHERE nth = 1"""),
        "sample_users": _with(("seen",), f"""
            SELECT user_id FROM (SELECT DISTINCT user_id FROM seen)
            ORDER BY md5(concat(user_id, ':{SEED}')), user_id LIMIT 500"""),
        "seen_counts": _with(("clicks",), """
            SELECT user_id, count(*) AS n_items FROM clicks GROUP BY user_id"""),
        "user_activity": _with(("activity",), "SELECT * FROM activity"),
        "item_popularity": _with(("popularity",), "SELECT * FROM popularity"),
        "popularity_norm": _with(("popularity",), """
            SELECT item_id, round(popularity / greatest((SELECT max(popularity) FROM popularity), 1), 6) AS share
            FROM popularity"""),
        "split_validation": _with(("validation",), f"SELECT {split_columns} FROM validation"),
        "split_test": _with(("test",), f"SELECT {split_columns} FROM test"),
        "split_summary": _with(("stacked",), """
            SELECT split, count(*) AS interactions, count(DISTINCT user_id) AS users,
                   count(DISTINCT item_id) AS items, CAST(min(event_time) AS VARCHAR) AS start_time,
                   CAST(max(event_time) AS VARCHAR) AS end_time, round(avg(label), 6) AS positive_rate
            FROM stacked GROUP BY split"""),
        "truth_warm": _with(("test", "items"), """
            SELECT DISTINCT user_id, item_id FROM test
            WHERE label > 0 AND item_id IN (SELECT item_id FROM items)"""),
        "truth_novel": _with(("test", "seen"), """
            SELECT DISTINCT user_id, item_id FROM test WHERE label > 0
            EXCEPT SELECT user_id, item_id FROM seen"""),
        "ground_truth": _with(("truth_validation",), "SELECT * FROM truth_validation"),
        "evaluated_users": _with(("truth_validation", "seen"), """
            SELECT DISTINCT user_id FROM seen
            WHERE user_id IN (SELECT user_id FROM truth_validation)"""),
        "feature_join": _with(("attached",), "SELECT * FROM attached"),
        "categorical_codes": _with(("attached", "sold"), """
            SELECT side, id, feature, value,
                   dense_rank() OVER (PARTITION BY side, feature ORDER BY value) - 1 AS code
            FROM (SELECT 'user' AS side, user_id AS id, 'segment' AS feature,
                         coalesce(segment, '__MISSING__') AS value FROM attached
                  UNION ALL
                  SELECT 'user', user_id, 'nation', coalesce(CAST(nation AS VARCHAR), '__MISSING__') FROM attached
                  UNION ALL SELECT 'item', item_id, 'brand', coalesce(brand, '__MISSING__') FROM sold
                  UNION ALL SELECT 'item', item_id, 'kind', coalesce(kind, '__MISSING__') FROM sold)"""),
        "numeric_features": _with(("attached", "sold"), """
            SELECT side, id, feature,
                   round((x - avg(x) OVER (PARTITION BY feature)) / stddev_pop(x) OVER (PARTITION BY feature), 6) AS number
            FROM (SELECT side, id, feature, sign(v) * ln(1 + abs(v)) AS x
                  FROM (SELECT side, id, feature, coalesce(v, median(v) OVER (PARTITION BY feature)) AS v
                        FROM (SELECT 'user' AS side, user_id AS id, 'balance' AS feature, balance AS v FROM attached
                              UNION ALL SELECT 'item', item_id, 'size', size FROM sold
                              UNION ALL SELECT 'item', item_id, 'price', price FROM sold)))"""),
        "causal_history": _with(("firsts",), f"""
            SELECT user_id, item_id, coalesce(array_to_string(list(item_id) OVER (
                PARTITION BY user_id
                ORDER BY event_time, l_orderkey, l_linenumber, item_id, l_suppkey, l_shipdate
                ROWS BETWEEN {HISTORY} PRECEDING AND 1 PRECEDING), ','), '') AS history
            FROM firsts"""),
        "strict_history": _with(("firsts",), f"""
            SELECT user_id, item_id, coalesce(array_to_string(list_slice(met, greatest(len(met) - {HISTORY - 1}, 1), len(met)), ','), '') AS history
            FROM (SELECT a.user_id, a.item_id, list(b.item_id ORDER BY b.event_time, b.l_orderkey, b.l_linenumber, b.item_id,
                         b.l_suppkey, b.l_shipdate) FILTER (WHERE b.item_id IS NOT NULL) AS met
                  FROM firsts a LEFT JOIN firsts b ON b.user_id = a.user_id AND b.event_time < a.event_time
                  GROUP BY a.user_id, a.item_id)"""),
        "serving_history": _with(("firsts",), f"""
            SELECT user_id, array_to_string(list(item_id ORDER BY back DESC), ',') AS history
            FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id
                      ORDER BY event_time DESC, l_orderkey DESC, l_linenumber DESC, item_id DESC,
                               l_suppkey DESC, l_shipdate DESC) AS back FROM firsts)
            WHERE back <= {HISTORY} GROUP BY user_id"""),
        "history_pool": _with(("pooled",), """
            SELECT user_id, CAST(dimension AS INTEGER) AS dimension, round(value, 6) AS value
            FROM pooled"""),
        "unit_norm": """
            SELECT vec_id, 1.0::DOUBLE AS norm, CAST(dimension AS INTEGER) AS dimension, round(value, 6) AS value
            FROM (SELECT vec_id, unnest(range(len(embedding))) AS dimension,
                         unnest([x / sqrt(list_sum([y * y FOR y IN v])) FOR x IN v]) AS value
                  FROM (SELECT vec_id, embedding, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))""",
        "in_batch_loss": _with(("clicks", "pooled"), """
            , user_vectors AS (
                SELECT user_id, list(value ORDER BY dimension) AS raw,
                       sqrt(sum(value * value)) AS size FROM pooled GROUP BY user_id),
            numbered_clicks AS (
                SELECT c.*, (row_number() OVER (ORDER BY c.user_id, c.item_id) - 1) // 128 AS batch
                FROM clicks c),
            rows AS (
                SELECT c.batch, c.user_id, c.item_id, [x / u.size FOR x IN u.raw] AS u,
                       CAST(e.embedding AS DOUBLE[]) AS v
                FROM numbered_clicks c JOIN user_vectors u USING (user_id)
                JOIN embeddings e ON e.vec_id = c.item_id),
            logits AS (
                SELECT a.batch, a.user_id, a.item_id, list_dot_product(a.u, b.v) / 0.07 AS logit,
                       a.user_id = b.user_id AND a.item_id = b.item_id AS own
                FROM rows a JOIN rows b ON a.batch = b.batch
                WHERE a.item_id <> b.item_id OR a.user_id = b.user_id)
            SELECT batch, count(*) AS n, round(avg(loss), 6) AS loss FROM (
                SELECT batch, user_id, item_id, ln(sum(exp(logit))) - max(logit) FILTER (WHERE own) AS loss
                FROM logits GROUP BY batch, user_id, item_id)
            GROUP BY batch""").replace("\n\n            , user_vectors", ", user_vectors"),
        "topk_per_user": _with(("click_log", "clicks"), f"""
            SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score FROM (
                SELECT s.*, row_number() OVER (PARTITION BY s.user_id
                    ORDER BY round(score, 9) DESC, coalesce(p.popularity, 0) DESC,
                             CAST(s.item_id AS VARCHAR)) AS rank
                FROM (SELECT user_id, item_id, avg(value) AS score
                      FROM click_log GROUP BY user_id, item_id) s
                LEFT JOIN (SELECT item_id, count(*) AS popularity FROM clicks GROUP BY item_id) p
                     ON p.item_id = s.item_id)
            WHERE rank <= {K}"""),
        "popularity_rank": _with(("popularity",), """
            SELECT item_id, popularity, row_number() OVER (
                ORDER BY popularity DESC, CAST(item_id AS VARCHAR)) AS place FROM popularity"""),
        "popularity_topk": _with(("popular",), """
            SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, CAST(popularity AS DOUBLE) AS score
            FROM popular"""),
        "fallback_topk": _with(("popular", "seen"), """
            SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id FROM popular
            WHERE user_id NOT IN (SELECT user_id FROM seen)"""),
        "nearest_cooccurrence": _with(("neighbors",), "SELECT item_id, neighbor_id, co_count FROM neighbors"),
        "cooccurrence": _with(("pair_counts",), "SELECT item_id, neighbor_id, co_count FROM pair_counts"),
        "cooccurrence_all": _with(("pair_counts",), "SELECT item_id, neighbor_id, co_count FROM pair_counts"),
        "item_neighbors": _with(("neighbors",), """
            SELECT item_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(similarity, 6) AS similarity
            FROM neighbors"""),
        "itemcf_scores": _click_cf("click_log", K) + """
            SELECT f.user_id, f.item_id, round(f.score, 6) AS score FROM cf_scores f
            ANTI JOIN seen s ON s.user_id = f.user_id AND s.item_id = f.item_id""",
        "itemcf_topk": _with(("cf",), """
            SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score FROM cf"""),
        "itemcf_topk_events": _click_cf("click_train", K) + """
            SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score FROM cf""",
        "dot_topk": f"""
            SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score FROM (
                SELECT *, row_number() OVER (PARTITION BY user_id
                    ORDER BY round(score, 9) DESC, CAST(item_id AS VARCHAR)) AS rank
                FROM (SELECT a.vec_id AS user_id, b.vec_id AS item_id, list_dot_product(
                          CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
                      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id))
            WHERE rank <= {K}""",
        "bpr_eligible": _with(("click_log", "clicks"), """
            SELECT c.user_id, c.item_id, n.n_items
            FROM clicks c JOIN (SELECT user_id, count(*) AS n_items FROM clicks GROUP BY user_id) n
                 ON n.user_id = c.user_id
            WHERE n.n_items < (SELECT count(DISTINCT item_id) FROM click_log)"""),
        "bpr_negatives": _negatives() + """
            SELECT user_id, item_id, part, CAST(0 AS INTEGER) AS shift, negative_id FROM negatives""",
        "bpr_epoch": _bpr_epoch(),
        "tower_vectors": _with(("item_tower", "user_tower"), """
            SELECT side, id, CAST(place - 1 AS INTEGER) AS place, round(v[place], 5) AS value
            FROM (SELECT 'item' AS side, item_id AS id, v FROM item_tower
                  UNION ALL SELECT 'user', user_id, v FROM user_tower WHERE item_id IS NULL),
                 (SELECT unnest([1, 2, 3]) AS place)"""),
        "first_epoch_loss": _with(("item_tower", "user_tower"), f"""
            , dealt AS (
                SELECT u.user_id, u.item_id, u.v AS u, i.v AS v,
                       {_code("concat(u.user_id, ':', u.item_id, ':0')")} % n.blocks AS block, n.blocks
                FROM user_tower u JOIN item_tower i ON i.item_id = u.item_id,
                     (SELECT CAST(ceil(count(*) / 400.0) AS BIGINT) AS blocks FROM user_tower WHERE item_id IS NOT NULL) n
                WHERE u.item_id IS NOT NULL)
            SELECT CAST(any_value(blocks) AS INTEGER) AS blocks, round(avg(loss), 4) AS loss FROM (
                SELECT a.user_id, a.item_id, any_value(a.blocks) AS blocks,
                       ln(sum(exp(list_dot_product(a.u, b.v) / 0.07))) - list_dot_product(any_value(a.u), any_value(a.v)) / 0.07 AS loss
                FROM dealt a JOIN dealt b ON a.block = b.block
                WHERE a.item_id <> b.item_id OR a.user_id = b.user_id
                GROUP BY a.user_id, a.item_id)""").replace("\n\n            , dealt", ", dealt"),
        "hits": _with(("popular", "truth_validation"), """
            SELECT r.user_id, CAST(r.rank AS INTEGER) AS rank, r.item_id,
                   CAST(t.item_id IS NOT NULL AS INTEGER) AS hit
            FROM popular r LEFT JOIN truth_validation t
                 ON t.user_id = r.user_id AND t.item_id = r.item_id
            WHERE r.user_id IN (SELECT user_id FROM truth_validation)"""),
        **{
            f"eval_{name}": _with(("recs", "per_user"), f"""
                SELECT user_id, round({name}, 6) AS {name} FROM per_user p WHERE {one}""")
            for name in ("recall", "hit_rate", "ndcg")
        },
        "eval_coverage": _with(("covered",), f"""
            SELECT CAST(k AS INTEGER) AS k, round(coverage, 6) AS coverage FROM covered p WHERE {one}"""),
        "evaluate": _with(("recs", "overall"), f"""
            SELECT k, recall, hit_rate, ndcg, coverage, evaluated_users FROM overall p WHERE {one}"""),
        "evaluate_multi_k": _with(("recs", "overall"), """
            SELECT k, recall, hit_rate, ndcg, coverage, evaluated_users FROM overall
            WHERE model = 'popularity' AND split = 'validation'"""),
        "activity_cuts": _with(("activity",), """
            SELECT round(quantile_cont(n_items, 1.0 / 3), 9) AS low,
                   round(quantile_cont(n_items, 2.0 / 3), 9) AS high FROM activity"""),
        "popularity_cuts": _with(("popularity",), """
            SELECT round(quantile_cont(popularity, 0.5), 9) AS low,
                   round(quantile_cont(popularity, 0.8), 9) AS high FROM popularity"""),
        "user_segments": _with(("user_groups",), "SELECT * FROM user_groups"),
        "item_segments": _with(("item_groups",), "SELECT * FROM item_groups"),
        "user_segment_lookup": _with(("customers", "user_groups"), """
            SELECT c.user_id, coalesce(g.segment, 'zero_positive') AS segment
            FROM customers c LEFT JOIN user_groups g ON g.user_id = c.user_id"""),
        "evaluate_user_segments": _with(("recs", "per_user", "shown", "user_groups", "items"), f"""
            SELECT m.segment, CAST(20 AS INTEGER) AS k, recall, hit_rate, ndcg, coverage, evaluated_users
            FROM (SELECT coalesce(g.segment, 'zero_positive') AS segment, {metrics}, count(*) AS evaluated_users
                  FROM per_user p LEFT JOIN user_groups g ON g.user_id = p.user_id
                  WHERE {one} GROUP BY 1) m
            JOIN (SELECT coalesce(g.segment, 'zero_positive') AS segment,
                         round(count(DISTINCT p.item_id) / (SELECT count(*) FROM items), 6) AS coverage
                  FROM shown p LEFT JOIN user_groups g ON g.user_id = p.user_id
                  WHERE {one} GROUP BY 1) c ON c.segment = m.segment"""),
        "evaluate_item_segments": _with(("popular", "truth_validation", "item_groups"), f"""
            SELECT m.segment, CAST({K} AS INTEGER) AS k, recall, hit_rate, ndcg,
                   round(coalesce(s.slots, 0) / s.total, 6) AS recommendation_share,
                   round(coalesce(s.shown, 0) / z.catalog_items, 6) AS group_coverage,
                   evaluated_users, z.catalog_items
            FROM (
                SELECT segment, {metrics}, count(*) AS evaluated_users FROM (
                    SELECT segment, user_id, n_hits / n_relevant AS recall,
                           CAST(n_hits > 0 AS DOUBLE) AS hit_rate,
                           gain / list_sum([1 / log2(r + 1) FOR r IN range(1, least(n_relevant, {K}) + 1)]) AS ndcg
                    FROM (SELECT g.segment, t.user_id, count(*) AS n_relevant, count(r.item_id) AS n_hits,
                                 coalesce(sum(1 / log2(r.rank + 1)), 0.0) AS gain
                          FROM truth_validation t JOIN item_groups g ON g.item_id = t.item_id
                          LEFT JOIN popular r ON r.user_id = t.user_id AND r.item_id = t.item_id
                          GROUP BY g.segment, t.user_id))
                GROUP BY segment) m
            JOIN (SELECT segment, count(*) AS catalog_items FROM item_groups GROUP BY segment) z
                 ON z.segment = m.segment
            JOIN (SELECT g.segment, count(r.item_id) AS slots, count(DISTINCT r.item_id) AS shown,
                         sum(count(r.item_id)) OVER () AS total
                  FROM item_groups g LEFT JOIN (
                      SELECT * FROM popular WHERE user_id IN (SELECT user_id FROM truth_validation)) r
                      ON r.item_id = g.item_id
                  GROUP BY g.segment) s ON s.segment = m.segment"""),
        "benchmark": _with(("recs", "overall", "per_user", "shown", "truth", "user_groups", "item_groups", "items"), f"""
            , grouped_users AS (
                SELECT m.model, m.split, m.segment, m.recall, m.hit_rate, m.ndcg, c.coverage, m.evaluated_users
                FROM (SELECT model, split, coalesce(g.segment, 'zero_positive') AS segment, {metrics},
                             count(*) AS evaluated_users
                      FROM per_user p LEFT JOIN user_groups g ON g.user_id = p.user_id
                      WHERE k = 20 GROUP BY 1, 2, 3) m
                JOIN (SELECT model, split, coalesce(g.segment, 'zero_positive') AS segment,
                             round(count(DISTINCT p.item_id) / (SELECT count(*) FROM items), 6) AS coverage
                      FROM shown p LEFT JOIN user_groups g ON g.user_id = p.user_id
                      WHERE k = 20 GROUP BY 1, 2, 3) c
                     ON c.model = m.model AND c.split = m.split AND c.segment = m.segment),
            item_hits AS (
                SELECT m.model, t.split, g.segment, t.user_id, count(*) AS n_relevant, count(r.item_id) AS n_hits,
                       coalesce(sum(1 / log2(r.rank + 1)), 0.0) AS gain
                FROM truth t JOIN item_groups g ON g.item_id = t.item_id
                CROSS JOIN (SELECT unnest(['popularity', 'itemcf']) AS model) m
                LEFT JOIN recs r ON r.model = m.model AND r.user_id = t.user_id AND r.item_id = t.item_id
                GROUP BY m.model, t.split, g.segment, t.user_id),
            item_means AS (
                SELECT model, split, segment, {metrics}, count(*) AS evaluated_users
                FROM (SELECT model, split, segment, n_hits / n_relevant AS recall,
                             CAST(n_hits > 0 AS DOUBLE) AS hit_rate,
                             gain / list_sum([1 / log2(r + 1) FOR r IN range(1, least(n_relevant, {K}) + 1)]) AS ndcg
                      FROM item_hits) GROUP BY model, split, segment),
            slots AS (
                SELECT s.model, s.split, g.segment, count(*) AS slots, count(DISTINCT s.item_id) AS shown,
                       sum(count(*)) OVER (PARTITION BY s.model, s.split) AS total
                FROM shown s JOIN item_groups g ON g.item_id = s.item_id
                WHERE s.k = 20 GROUP BY s.model, s.split, g.segment),
            sizes AS (SELECT segment, count(*) AS n FROM item_groups GROUP BY segment)
            SELECT 'overall' AS part, 'all' AS segment, model, split, k, recall, hit_rate, ndcg, coverage,
                   CAST(NULL AS DOUBLE) AS recommendation_share, CAST(NULL AS DOUBLE) AS group_coverage, evaluated_users
            FROM overall WHERE k = 20
            UNION ALL
            SELECT 'user', segment, model, split, CAST(20 AS INTEGER), recall, hit_rate, ndcg, coverage,
                   NULL, NULL, evaluated_users FROM grouped_users
            UNION ALL
            SELECT 'item', m.segment, m.model, m.split, CAST(20 AS INTEGER), recall, hit_rate, ndcg, NULL,
                   round(coalesce(s.slots, 0) / (SELECT any_value(x.total) FROM slots x WHERE x.model = m.model AND x.split = m.split), 6),
                   round(coalesce(s.shown, 0) / z.n, 6), evaluated_users
            FROM item_means m JOIN sizes z ON z.segment = m.segment
            LEFT JOIN slots s ON s.model = m.model AND s.split = m.split AND s.segment = m.segment""").replace("\n\n            , grouped_users", ", grouped_users"),
    }
