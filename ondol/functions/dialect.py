"""The few expressions in which Spark SQL and DuckDB differ, so that a plan and its oracle share one text."""

from __future__ import annotations


def _braces(pattern: str) -> str:
    """Plans for Spark hold table names in braces, so others are doubled."""
    return pattern.replace("{", "{{").replace("}", "}}")


class Spark:
    table = staticmethod(lambda name: "{" + name + "}")
    div = staticmethod(lambda a, b: f"(({a}) div ({b}))")
    long = staticmethod(lambda x: f"cast({x} as bigint)")
    words = staticmethod(lambda x: f"regexp_extract_all(lower({x}), '[\\\\p{{{{L}}}}\\\\p{{{{N}}}}_]+', 0)")
    sha = staticmethod(lambda x: f"sha2({x}, 256)")
    cosine = staticmethod(lambda a, b: f"(aggregate(zip_with({a}, {b}, (p, q) -> cast(p as double) * q), 0D, (s, v) -> s + v) / sqrt(aggregate({a}, 0D, (s, v) -> s + cast(v as double) * v) * aggregate({b}, 0D, (s, v) -> s + cast(v as double) * v)))")
    explode = staticmethod(lambda x: f"explode({x})")
    seconds = staticmethod(lambda x: f"unix_timestamp({x})")
    replace = staticmethod(lambda x, pattern, by: f"regexp_replace({x}, '{pattern}', '{by}')")
    groups = staticmethod(lambda x, pattern: f"regexp_extract_all({x}, '{pattern}', 1)")
    percentile = staticmethod(lambda x, p: f"percentile({x}, {p})")
    overlap = staticmethod(lambda a, b: f"coalesce(array_max(filter(sequence(0, least(size({a}), size({b}))), k -> k > 0 AND slice({a}, size({a}) - k + 1, k) = slice({b}, 1, k))), 0)")
    none_in = staticmethod(lambda words, text: f"NOT exists({words}, w -> contains({text}, w))")
    keep_long = staticmethod(lambda words, n, stop: f"filter({words}, w -> length(w) >= {n} AND w NOT IN ({stop}))")
    size = staticmethod(lambda x: f"size({x})")
    distinct = staticmethod(lambda x: f"array_distinct({x})")
    numbers = staticmethod(lambda n: f"sequence(0, {n - 1})")
    rlike = staticmethod(lambda x, p: f"({x}) RLIKE r'{_braces(p)}'")
    sub = staticmethod(lambda x, p, by: f"regexp_replace({x}, r'{_braces(p)}', '{by}')")
    found = staticmethod(lambda x, p, group=0: f"regexp_extract({x}, r'{_braces(p)}', {group})")
    all_found = staticmethod(lambda x, p, group=0: f"regexp_extract_all({x}, r'{_braces(p)}', {group})")
    joined = staticmethod(lambda x, sep, order: f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {order})")
    first_token = staticmethod(lambda x, rule: f"try_element_at(filter(transform(split({x}, ','), t -> {rule('trim(t)')}), v -> v IS NOT NULL), 1)")
    array = staticmethod(lambda *xs: f"array({', '.join(xs)})")
    keep = staticmethod(lambda xs, test: f"filter({xs}, x -> {test('x')})")
    each = staticmethod(lambda xs, f: f"transform({xs}, x -> {f('x')})")
    any_of = staticmethod(lambda xs, test: f"exists({xs}, x -> {test('x')})")
    both = staticmethod(lambda a, b: f"array_intersect({a}, {b})")
    minus = staticmethod(lambda a, b: f"array_except({a}, {b})")
    text = staticmethod(lambda xs, sep=",": f"array_join({xs}, '{sep}')")
    split = staticmethod(lambda x, sep: f"split({x}, '{sep}')")
    strlen = staticmethod(lambda x: f"length({x})")


class Duck:
    table = staticmethod(lambda name: name)
    div = staticmethod(lambda a, b: f"(({a}) // ({b}))")
    long = staticmethod(lambda x: f"cast(trunc({x}) as bigint)")
    words = staticmethod(lambda x: f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')")
    sha = staticmethod(lambda x: f"sha256({x})")
    cosine = staticmethod(lambda a, b: f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])")
    explode = staticmethod(lambda x: f"unnest({x})")
    seconds = staticmethod(lambda x: f"cast(floor(epoch({x})) as bigint)")
    replace = staticmethod(lambda x, pattern, by: f"regexp_replace({x}, '{pattern}', '{by}', 'g')")
    groups = staticmethod(lambda x, pattern: f"regexp_extract_all({x}, '{pattern}', 1)")
    percentile = staticmethod(lambda x, p: f"quantile_cont({x}, {p})")
    overlap = staticmethod(lambda a, b: f"coalesce(list_max(list_filter(range(1, least(len({a}), len({b})) + 1), lambda k: {a}[len({a}) - k + 1 : len({a})] = {b}[1:k])), 0)")
    none_in = staticmethod(lambda words, text: f"len(list_filter({words}, lambda w: contains({text}, w))) = 0")
    keep_long = staticmethod(lambda words, n, stop: f"list_filter({words}, lambda w: length(w) >= {n} AND w NOT IN ({stop}))")
    size = staticmethod(lambda x: f"len({x})")
    distinct = staticmethod(lambda x: f"list_distinct({x})")
    numbers = staticmethod(lambda n: f"range({n})")
    rlike = staticmethod(lambda x, p: f"regexp_matches({x}, '{p}')")
    sub = staticmethod(lambda x, p, by: f"regexp_replace({x}, '{p}', '{by}', 'g')")
    found = staticmethod(lambda x, p, group=0: f"regexp_extract({x}, '{p}', {group})")
    all_found = staticmethod(lambda x, p, group=0: f"regexp_extract_all({x}, '{p}', {group})")
    joined = staticmethod(lambda x, sep, order: f"string_agg({x}, '{sep}' ORDER BY {order})")
    first_token = staticmethod(lambda x, rule: f"list_filter(list_transform(string_split({x}, ','), lambda t: {rule('trim(t)')}), lambda v: v IS NOT NULL)[1]")
    array = staticmethod(lambda *xs: f"[{', '.join(xs)}]")
    keep = staticmethod(lambda xs, test: f"list_filter({xs}, lambda x: {test('x')})")
    each = staticmethod(lambda xs, f: f"list_transform({xs}, lambda x: {f('x')})")
    any_of = staticmethod(lambda xs, test: f"len(list_filter({xs}, lambda x: {test('x')})) > 0")
    both = staticmethod(lambda a, b: f"list_filter({a}, lambda x: list_contains({b}, x))")
    minus = staticmethod(lambda a, b: f"list_filter({a}, lambda x: NOT list_contains({b}, x))")
    text = staticmethod(lambda xs, sep=",": f"array_to_string({xs}, '{sep}')")
    split = staticmethod(lambda x, sep: f"string_split({x}, '{sep}')")
    strlen = staticmethod(lambda x: f"length({x})")
