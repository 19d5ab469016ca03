"""The few spellings in which Spark SQL and the oracle's SQL differ; a query is written once over them."""

from __future__ import annotations

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _over_deviation(a: str, x: str) -> str:
    """a over the sample deviation of the gathered x by the oracle's running mean and sum of squares, step by step over the
    ascending values: Spark's own deviation rounds elsewhere, which shows where the values are nearly equal. Over 0 as IEEE has it."""
    mean, variance = "(s.mean + (v - s.mean) / (s.n + 1))", "s.squares / (s.n - 1)"
    step = f"named_struct('n', s.n + 1, 'mean', {mean}, 'squares', s.squares + (v - {mean}) * (v - s.mean))"
    end = f"CASE WHEN s.n > 1 THEN CASE WHEN {variance} > 0 THEN {a} / sqrt({variance}) WHEN {a} > 0 THEN double('Infinity') ELSE double('NaN') END END"
    return f"aggregate(sort_array({x}), named_struct('n', 0e0, 'mean', 0e0, 'squares', 0e0), (s, v) -> {step}, s -> {end})"


class Spark:
    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir
        for t in TABLES:
            setattr(self, t, f"parquet.`{sf_dir}/{t}.parquet`")

    days = staticmethod(lambda a, b: f"datediff({a}, {b})")
    join = staticmethod(lambda x, sep, order: f"string_agg({x}, '{sep}') WITHIN GROUP (ORDER BY {order})")
    sha = staticmethod(lambda x: f"sha2({x}, 256)")
    rx_all = staticmethod(lambda x, p: f"regexp_extract_all({x}, r'({p})', 1)")
    rx_has = staticmethod(lambda x, p: f"({x} RLIKE r'{p}')")
    rx_sub = staticmethod(lambda x, p, by: f"regexp_replace({x}, r'{p}', '{by}')")
    words = staticmethod(lambda x: f"filter(split({x}, r'[^a-z]+'), w -> w <> '')")
    explode = staticmethod(lambda x: f"explode({x})")
    size = staticmethod(lambda x: f"CAST(size({x}) AS BIGINT)")
    distinct = staticmethod(lambda x: f"array_distinct({x})")
    overlap = staticmethod(lambda a, b: f"array_intersect({a}, {b})")
    bigrams = staticmethod(lambda x: f"array_distinct(transform(sequence(1, greatest(length({x}) - 1, 1)), i -> substring({x}, i, 2)))")
    at = staticmethod(lambda a, i: f"get({a}, CAST({i} AS INT))")
    sorted_list = staticmethod(lambda x, where="true": f"array_sort(collect_list({x}) FILTER (WHERE {where}))")
    json_text = staticmethod(lambda x, k: f"get_json_object({x}, '$.{k}')")
    epoch_days = staticmethod(lambda x: f"unix_date(CAST({x} AS DATE))")
    try_date = staticmethod(lambda x: f"try_cast({x} AS DATE)")
    # the oracle's cast to whole seconds rounds, halves to even: the last half second of a window is in the next one
    window_from = staticmethod(lambda size: f"(CAST(rint(unix_micros(CAST(ts AS TIMESTAMP)) / 1e6) AS BIGINT) DIV {size}) * {size}")
    gathered_deviation = staticmethod(lambda x: f"collect_list({x})")
    over_deviation = staticmethod(_over_deviation)
    seconds = staticmethod(lambda x: f"unix_seconds(CAST({x} AS TIMESTAMP))")
    div = staticmethod(lambda a, b: f"({a} DIV {b})")
    records = staticmethod(lambda rows: "explode(array(" + ", ".join("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in r.items()) + ")" for r in rows) + "))")


class Duck:
    def __init__(self):
        for t in TABLES:
            setattr(self, t, t)

    days = staticmethod(lambda a, b: f"date_diff('day', {b}, {a})")
    join = staticmethod(lambda x, sep, order: f"string_agg({x}, '{sep}' ORDER BY {order})")
    sha = staticmethod(lambda x: f"sha256({x})")
    rx_all = staticmethod(lambda x, p: f"regexp_extract_all({x}, '({p})', 1)")
    rx_has = staticmethod(lambda x, p: f"regexp_matches({x}, '{p}')")
    rx_sub = staticmethod(lambda x, p, by: f"regexp_replace({x}, '{p}', '{by}', 'g')")
    words = staticmethod(lambda x: f"regexp_extract_all({x}, '[a-z]+')")
    explode = staticmethod(lambda x: f"unnest({x})")
    size = staticmethod(lambda x: f"CAST(len({x}) AS BIGINT)")
    distinct = staticmethod(lambda x: f"list_distinct({x})")
    overlap = staticmethod(lambda a, b: f"list_intersect({a}, {b})")
    bigrams = staticmethod(lambda x: f"list_distinct(list_transform(range(1, greatest(length({x}) - 1, 1) + 1), lambda i: substring({x}, i, 2)))")
    at = staticmethod(lambda a, i: f"{a}[CAST({i} AS INT) + 1]")
    sorted_list = staticmethod(lambda x, where="true": f"list_sort(list({x}) FILTER (WHERE {where}))")
    json_text = staticmethod(lambda x, k: f"json_extract_string({x}, '$.{k}')")
    epoch_days = staticmethod(lambda x: f"date_diff('day', DATE '1970-01-01', CAST({x} AS DATE))")
    try_date = staticmethod(lambda x: f"try_cast({x} AS DATE)")
    window_from = staticmethod(lambda size: f"CAST(epoch(ts) AS BIGINT) // {size} * {size}")
    gathered_deviation = staticmethod(lambda x: f"stddev_samp({x})")
    over_deviation = staticmethod(lambda a, x: f"{a} / {x}")
    seconds = staticmethod(lambda x: f"CAST(floor(epoch({x})) AS BIGINT)")
    div = staticmethod(lambda a, b: f"({a} // {b})")
    records = staticmethod(lambda rows: "unnest([" + ", ".join("{" + ", ".join(f"'{k}': {v}" for k, v in r.items()) + "}" for r in rows) + "])")
