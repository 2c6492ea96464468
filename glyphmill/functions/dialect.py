"""The few spots where SQL differs between Spark and the engine that checks it.

Plans are SQL texts over named relations. Randomness is a hash of the row's key, so it's the same everywhere.
"""

from __future__ import annotations

import math


class Spark:
    name = "spark"

    def hash32(self, key: str) -> str:
        """A whole number from 0 to 2**32 - 1 from the md5 of key."""
        return f"cast(conv(substr(md5({key}), 1, 8), 16, 10) as bigint)"

    def u(self, key: str) -> str:
        """A number from 0 to 1, 1 excluded."""
        return f"({self.hash32(key)} / 4294967296.0e0)"

    def each(self, low: str, high: str, name: str) -> str:
        """Goes behind a FROM clause: a row for every whole number from low to high."""
        return f"lateral view explode(case when {high} >= {low} then sequence(cast({low} as bigint), cast({high} as bigint)) else cast(array() as array<bigint>) end) t_{name} as {name}"

    def items(self, array: str, name: str) -> str:
        """Goes behind a FROM clause: a row for every item of an array."""
        return f"lateral view explode({array}) t_{name} as {name}"

    def numbered(self, array: str, at: str, name: str) -> str:
        """Items with their places from 0."""
        return f"lateral view posexplode({array}) t_{name} as {at}, {name}"

    def runs(self, array: str, at: str, name: str) -> str:
        """Items with the two after them, as a struct of a, b and c, and their places from 0. Rows carry these alone, not the array."""
        two = f"zip_with({array}, slice({array}, 2, greatest(size({array}), 1)), (x_, y_) -> struct(x_ as a, y_ as b))"
        return f"lateral view posexplode(zip_with({two}, slice({array}, 3, greatest(size({array}), 1)), (p_, z_) -> struct(p_.a as a, p_.b as b, z_ as c))) t_{name} as {at}, {name}"

    def joined_arrays(self, first: str, second: str) -> str:
        return f"concat({first}, {second})"

    def percentile(self, x: str, p: str) -> str:
        return f"percentile({x}, {p})"

    def find_all(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, r'{pattern}', 0)"

    def matches(self, text: str, pattern: str) -> str:
        """The whole text matches."""
        return f"{text} rlike r'^(?:{pattern})$'"

    def replace_all(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, r'{pattern}', r'{by}')"

    def group(self, k: int) -> str:
        return f"${k}"

    def extract(self, text: str, pattern: str, k: int = 0) -> str:
        return f"regexp_extract({text}, r'{pattern}', {k})"

    def size(self, array: str) -> str:
        return f"size({array})"

    def item(self, array: str, k: str) -> str:
        """The k-th from 1, or null."""
        return f"try_element_at({array}, cast({k} as int))"

    #: Function that makes an array of its arguments.
    array_name = "array"

    def slice(self, array: str, start: str, n: str) -> str:
        """n items from the start-th on, from 1."""
        return f"slice({array}, {start}, {n})"

    def text_of(self, array: str) -> str:
        """Items joined by blanks."""
        return f"array_join({array}, ' ')"

    def split(self, text: str, mark: str) -> str:
        return f"split({text}, r'{mark}')"

    def json(self, text: str, path: str) -> str:
        return f"get_json_object({text}, '$.{path}')"

    def day(self, ts: str) -> str:
        return f"cast({ts} as date)"

    def joined(self, x: str, order: str, mark: str = " ") -> str:
        """Items of a group in order, in one text."""
        return f"array_join(transform(array_sort(collect_list(struct({order}, {x} as x_))), s -> s.x_), '{mark}')"

    def edits(self, a: str, b: str) -> str:
        """Edit distance in characters."""
        return f"levenshtein({a}, {b})"

    def within(self, a: str, b: str, k: int) -> str:
        """Edit distance of at most k, given up beyond."""
        return f"(levenshtein({a}, {b}, {k}) >= 0)"

    def shuffled(self, array: str, key: str) -> str:
        """Items in the order of md5s of key and place."""
        return f"transform(sort_array(transform({array}, (w, i) -> struct(md5(concat({key}, ':', cast(i as string))) as h, w as w))), s -> s.w)"

    def ln_factorial(self, n: str) -> str:
        """ln n! from Stirling's series, exact for small n."""
        x = f"({n} * 1.0e0)"
        return f"(case when {n} < 16 then ln(cast(factorial(cast(least({n}, 16) as int)) as double)) else ({x} + 0.5e0) * ln({x}) - {x} + 0.9189385332046727e0 + 1 / (12 * {x}) - 1 / (360 * {x} * {x} * {x}) end)"


class Duck(Spark):
    name = "duckdb"

    #: Its levenshtein() counts bytes; letters of the tables that take two stand for one each, which words don't hold.
    ACCENTED, PLAIN = "éèêçüäößóñíáúâîàùûôëïœæ", "ABCDEFGHIJKLMNOPQRSTUVW"

    def edits(self, a: str, b: str) -> str:
        return f"levenshtein(translate({a}, '{self.ACCENTED}', '{self.PLAIN}'), translate({b}, '{self.ACCENTED}', '{self.PLAIN}'))"

    def within(self, a: str, b: str, k: int) -> str:
        return f"({self.edits(a, b)} <= {k})"

    def shuffled(self, array: str, key: str) -> str:
        return f"list_transform(list_sort(list_transform(range(0, len({array})), lambda i: {{{{'h': md5(concat({key}, ':', cast(i as varchar))), 'w': {array}[i + 1]}}}})), lambda s: s.w)"

    def hash32(self, key: str) -> str:
        return f"cast('0x' || substr(md5({key}), 1, 8) as bigint)"

    def each(self, low: str, high: str, name: str) -> str:
        return f", unnest(generate_series(cast({low} as bigint), cast({high} as bigint))) as t_{name}({name})"

    def items(self, array: str, name: str) -> str:
        return f", unnest({array}) as t_{name}({name})"

    def numbered(self, array: str, at: str, name: str) -> str:
        return f", unnest(list_zip(range(0, len({array})), {array})) as z_{name}(p_{name}), (select p_{name}[1]::int as {at}, p_{name}[2] as {name})"

    def runs(self, array: str, at: str, name: str) -> str:
        zipped = f"list_zip(range(0, len({array})), {array}, {array}[2:], {array}[3:])"
        return f", unnest({zipped}) as z_{name}(q_{name}), (select q_{name}[1]::int as {at}, {{{{'a': q_{name}[2], 'b': q_{name}[3], 'c': q_{name}[4]}}}} as {name})"

    def joined_arrays(self, first: str, second: str) -> str:
        return f"list_concat({first}, {second})"

    def percentile(self, x: str, p: str) -> str:
        return f"quantile_cont({x}, {p})"

    def find_all(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, '{pattern}')"

    def matches(self, text: str, pattern: str) -> str:
        return f"regexp_full_match({text}, '{pattern}')"

    def replace_all(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"

    def group(self, k: int) -> str:
        return f"\\{k}"

    def extract(self, text: str, pattern: str, k: int = 0) -> str:
        return f"regexp_extract({text}, '{pattern}', {k})"

    def size(self, array: str) -> str:
        return f"len({array})"

    array_name = "list_value"

    def slice(self, array: str, start: str, n: str) -> str:
        return f"{array}[{start}:({start}) + ({n}) - 1]"

    def text_of(self, array: str) -> str:
        return f"array_to_string({array}, ' ')"

    def item(self, array: str, k: str) -> str:
        return f"{array}[cast({k} as int)]"

    def split(self, text: str, mark: str) -> str:
        return f"string_split_regex({text}, '{mark}')"

    def json(self, text: str, path: str) -> str:
        return f"json_extract_string({text}, '$.{path}')"

    def joined(self, x: str, order: str, mark: str = " ") -> str:
        return f"string_agg({x}, '{mark}' order by {order})"


def poisson_ends() -> list[float]:
    """Numbers below which a unit is drawn 0, 1, ... 11 times."""
    below, ends = 0.0, []
    for k in range(12):
        below += math.exp(-1) / math.factorial(k)
        ends.append(float(f"{below:.15f}"))
    return ends


def poisson(u: str) -> str:
    """How often a unit is drawn, by a number from 0 to 1: Poisson of mean 1, at most 12."""
    cases = [f"when {u} < {below:.15f}e0 then {k}" for k, below in enumerate(poisson_ends())]
    return f"case {' '.join(cases)} else 12 end"


SPARK, DUCK = Spark(), Duck()
