"""The few places where Spark SQL and DuckDB spell the same expression differently.

A plan is written once; Spark runs it, and the oracle prints it for DuckDB.
"""

from __future__ import annotations


def _dotted(path: str) -> str:
    return path if not path or path[0] == "[" else f".{path}"


class Spark:
    name = "spark"

    def lit(self, pattern: str) -> str:
        return 'r"' + pattern + '"'

    def matches(self, column: str, pattern: str) -> str:
        return f"({column} RLIKE {self.lit(pattern)})"

    def group(self, column: str, pattern: str, k: int) -> str:
        return f"regexp_extract({column}, {self.lit(pattern)}, {k})"

    def replace(self, column: str, pattern: str, by: str) -> str:
        return f"regexp_replace({column}, {self.lit(pattern)}, '{by}')"

    def split(self, column: str, pattern: str) -> str:
        return f"split({column}, {self.lit(pattern)})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def map(self, items: str, x: str, body: str) -> str:
        return f"transform({items}, {x} -> {body})"

    def map_at(self, items: str, x: str, i: str, body: str) -> str:
        """i counts from 1 in the body."""
        return f"transform({items}, ({x}, {i}0) -> {body.replace(f'<{i}>', f'({i}0 + 1)')})"

    def filter(self, items: str, x: str, condition: str) -> str:
        return f"filter({items}, {x} -> {condition})"

    def find(self, items: str, value: str) -> str:
        return f"CAST(coalesce(array_position({items}, {value}), 0) AS INT)"

    def join(self, items: str, by: str) -> str:
        return f"array_join({items}, {by})"

    def fold(self, items: str, start: str, acc: str, x: str, body: str) -> str:
        return f"aggregate({items}, {start}, ({acc}, {x}) -> {body})"

    def append(self, items: str, item: str) -> str:
        return f"concat({items}, array({item}))"

    def last(self, items: str) -> str:
        return f"element_at({items}, -1)"

    def first(self, items: str) -> str:
        return f"get({items}, 0)"

    def struct(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def gather(self, item: str) -> str:
        """Array of structs in their own order."""
        return f"array_sort(collect_list({item}))"

    def empty(self, kind: str) -> str:
        return f"CAST(array() AS ARRAY<{kind}>)"

    def half_even(self, x: str) -> str:
        return f"CAST(rint({x}) AS INT)"

    def whole(self, x: str) -> str:
        """The nearest whole number as a double; halves go to the even one."""
        return f"rint({x})"

    def hundredths(self, x: str) -> str:
        """x at two decimals as its exact binary value rounds; only true halves go to the even one.

        Whether x * 100 is a half is not told from the product, which is itself rounded: where it
        looks like one, the sign of its exact residual (by splitting x into two halves of its bits) decides.
        """
        x = f"({x})"
        product, split = f"({x} * 100)", f"({x} * CAST(134217729 AS DOUBLE))"
        high = f"({split} - ({split} - {x}))"
        residual = f"(({high} * 100 - {product}) + ({x} - {high}) * 100)"
        return f"CASE WHEN abs({x}) >= 70368744177664 THEN {x} WHEN abs({product} - {self.whole(product)}) <> 0.5 THEN {self.whole(product)} / 100 WHEN {residual} > 0 THEN CAST(ceil({product}) AS DOUBLE) / 100 WHEN {residual} < 0 THEN CAST(floor({product}) AS DOUBLE) / 100 ELSE {self.whole(product)} / 100 END"

    def strings(self, item: str) -> str:
        """Distinct strings of a group, sorted and joined by a comma."""
        return f"array_join(array_sort(collect_set({item})), ',')"

    def explode(self, relation: str, columns: str, items: str, alias: str) -> str:
        return f"SELECT {columns}, {alias} FROM {relation} LATERAL VIEW explode({items}) AS {alias}"

    def json(self, column: str, path: str) -> str:
        return f"get_json_object({column}, '$.{path}')"

    def known(self, which: str, column: str) -> str:
        """first_value or last_value that skips nulls, for OVER."""
        return f"{which}({column}) IGNORE NULLS"

    def steps(self, n: str) -> str:
        """The numbers from 1 to n as an array."""
        return f"sequence(1, CAST({n} AS INT))"

    # JSON values that were parsed once; paths are like "a.b" or "[0]"

    def parse(self, text: str) -> str:
        """The parsed text, null where it is no JSON."""
        return f"try_parse_json({text})"

    def at(self, value: str, path: str) -> str:
        return f"try_variant_get({value}, '${_dotted(path)}', 'variant')"

    def text_at(self, value: str, path: str) -> str:
        return f"try_variant_get({value}, '${_dotted(path)}', 'string')"

    def object_text(self, value: str, path: str) -> str:
        """The JSON text of the value at a path, null where it is absent."""
        return f"to_json({self.at(value, path)})"

    def number_at(self, value: str, path: str) -> str:
        return f"try_variant_get({value}, '${_dotted(path)}', 'double')"

    def length_at(self, value: str, path: str) -> str:
        """How many items the array at a path has, 0 where there is none."""
        return f"coalesce(greatest(0, size({self.shallow(value, path, 'array')})), 0)"

    def items(self, relation: str, columns: str, path: str, rest: str = "true") -> str:
        """A row for each item of the array at a path of v: the columns, i (from 0) and v.

        A field is reached by a row for each field of its object: taken out by its path, all below it would be built anew.
        """
        if path and not set(path) & set(".["):
            return f"SELECT {columns}, e.pos AS i, e.value AS v FROM {relation} r, LATERAL variant_explode(r.v) AS o, LATERAL variant_explode(o.value) AS e WHERE o.key = '{path}' AND e.key IS NULL AND ({rest})"
        at = self.at("r.v", path) if path else "r.v"
        return f"SELECT {columns}, e.pos AS i, e.value AS v FROM {relation} r, LATERAL variant_explode({at}) AS e WHERE e.key IS NULL AND ({rest})"

    def entries(self, relation: str, columns: str, path: str, rest: str = "true") -> str:
        """A row for each field of the object at a path of v: the columns, field and v."""
        return f"SELECT {columns}, e.key AS field, e.value AS v FROM {relation} r, LATERAL variant_explode({self.at('r.v', path)}) AS e WHERE e.key IS NOT NULL AND ({rest})"

    def shallow(self, value: str, path: str, kind: str) -> str:
        """The array or object at a path without what it holds, null where there is none; nothing below it is built."""
        return f"try_variant_get({value}, '${_dotted(path)}', '{'array<struct<>>' if kind == 'array' else 'struct<>'}')"

    def is_kind(self, value: str, path: str, kinds: tuple[str, ...]) -> str:
        """Whether the value is of one of the kinds that `kind` names, or absent; containers are told by a shallow cast, all others by one look at the schema."""
        at = self.at(value, path) if path else value
        scalars = {"int": "BIGINT", "string": "STRING", "bool": "BOOLEAN", "number": "DECIMAL', 'DOUBLE"}
        names = [f"'{name}'" for k, name in scalars.items() if k in kinds]
        tests = [f"coalesce(substring_index(schema_of_variant({at}), '(', 1) IN ({', '.join(names)}), false)"] * bool(names)
        tests += [f"{self.shallow(value, path, k)} IS NOT NULL" for k in ("array", "object") if k in kinds]
        tests += [f"({at}) IS NULL"] * ("absent" in kinds) + [f"is_variant_null({at})"] * ("null" in kinds)
        return f"({' OR '.join(tests)})"

    def four_numbers(self, value: str, path: str) -> str:
        """Whether the value is an array of exactly four numbers: its schema has numbers only, and none of the four is null."""
        of_numbers = f"coalesce(substring_index(schema_of_variant({self.at(value, path) if path else value}), '(', 1) IN ('ARRAY<BIGINT>', 'ARRAY<DECIMAL', 'ARRAY<DOUBLE>'), false)"
        count = f"aggregate(try_variant_get({value}, '${_dotted(path)}', 'array<double>'), 0, (n, x) -> n + CASE WHEN x IS NULL THEN 5 ELSE 1 END)"
        return f"({of_numbers} AND {count} = 4)"

    def kind(self, value: str, path: str = "") -> str:
        """null, number, int, string, bool, array or object; SQL null where the path is absent."""
        k = f"schema_of_variant({self.at(value, path) if path else value})"
        return f"CASE WHEN {k} = 'VOID' THEN 'null' WHEN {k} = 'BIGINT' THEN 'int' WHEN {k} LIKE 'DECIMAL%' OR {k} = 'DOUBLE' THEN 'number' WHEN {k} = 'STRING' THEN 'string' WHEN {k} = 'BOOLEAN' THEN 'bool' WHEN {k} LIKE 'ARRAY%' THEN 'array' WHEN {k} LIKE 'OBJECT%' THEN 'object' END"

    text = "STRING"


class DuckDB(Spark):
    name = "duckdb"
    def known(self, which: str, column: str) -> str:
        return f"{which}({column} IGNORE NULLS)"

    def steps(self, n: str) -> str:
        return f"range(1, CAST({n} AS INT) + 1)"

    def parse(self, text: str) -> str:
        return f"TRY_CAST({text} AS JSON)"

    def at(self, value: str, path: str) -> str:
        return f"json_extract({value}, '${_dotted(path)}')"

    def text_at(self, value: str, path: str) -> str:
        return f"json_extract_string({value}, '${_dotted(path)}')"

    def object_text(self, value: str, path: str) -> str:
        return f"CAST({self.at(value, path)} AS VARCHAR)"

    def number_at(self, value: str, path: str) -> str:
        return f"TRY_CAST({self.text_at(value, path)} AS DOUBLE)"

    def length_at(self, value: str, path: str) -> str:
        return f"coalesce(json_array_length({value}, '${_dotted(path)}'), 0)"

    def items(self, relation: str, columns: str, path: str, rest: str = "true") -> str:
        inner = f"SELECT r.*, json_extract(r.v, '${_dotted(path)}[*]') AS l FROM {relation} r WHERE json_type(r.v, '${_dotted(path)}') = 'ARRAY' AND ({rest})"
        return f"SELECT {columns}, r.i, r.v FROM (SELECT r.* EXCLUDE (v, l), generate_subscripts(l, 1) - 1 AS i, unnest(l) AS v FROM ({inner}) AS r) AS r"

    def entries(self, relation: str, columns: str, path: str, rest: str = "true") -> str:
        inner = f"SELECT r.*, unnest(json_keys(r.v, '${_dotted(path)}')) AS field FROM {relation} r WHERE json_type(r.v, '${_dotted(path)}') = 'OBJECT' AND ({rest})"
        return f"SELECT {columns}, r.field, json_extract(r.v, concat('${_dotted(path)}.', r.field)) AS v FROM ({inner}) AS r"

    def four_numbers(self, value: str, path: str) -> str:
        item = lambda k, *kinds: self.is_kind(value, f"{path}[{k}]", kinds)
        return f"({self.is_kind(value, path, ('array',))} AND {' AND '.join(item(k, 'int', 'number') for k in range(4))} AND {item(4, 'absent')})"

    def is_kind(self, value: str, path: str, kinds: tuple[str, ...]) -> str:
        return f"coalesce({self.kind(value, path)}, 'absent') IN ({', '.join(repr(k) for k in kinds)})"

    def kind(self, value: str, path: str = "") -> str:
        k = f"json_type({value}, '${_dotted(path)}')"
        return f"CASE WHEN {k} = 'NULL' THEN 'null' WHEN {k} IN ('BIGINT', 'UBIGINT') THEN 'int' WHEN {k} = 'DOUBLE' THEN 'number' WHEN {k} = 'VARCHAR' THEN 'string' WHEN {k} = 'BOOLEAN' THEN 'bool' WHEN {k} = 'ARRAY' THEN 'array' WHEN {k} = 'OBJECT' THEN 'object' END"

    text = "VARCHAR"

    def lit(self, pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def matches(self, column: str, pattern: str) -> str:
        return f"regexp_matches({column}, {self.lit(pattern)})"

    def replace(self, column: str, pattern: str, by: str) -> str:
        return f"regexp_replace({column}, {self.lit(pattern)}, '{by}', 'g')"

    def split(self, column: str, pattern: str) -> str:
        return f"regexp_split_to_array({column}, {self.lit(pattern)})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def map(self, items: str, x: str, body: str) -> str:
        return f"list_transform({items}, lambda {x}: {body})"

    def map_at(self, items: str, x: str, i: str, body: str) -> str:
        return f"list_transform({items}, lambda {x}, {i}0: {body.replace(f'<{i}>', f'{i}0')})"

    def filter(self, items: str, x: str, condition: str) -> str:
        return f"list_filter({items}, lambda {x}: {condition})"

    def find(self, items: str, value: str) -> str:
        return f"CAST(coalesce(list_position({items}, {value}), 0) AS INT)"

    def join(self, items: str, by: str) -> str:
        return f"array_to_string({items}, {by})"

    def fold(self, items: str, start: str, acc: str, x: str, body: str) -> str:
        return f"list_reduce({items}, lambda {acc}, {x}: {body}, {start})"

    def append(self, items: str, item: str) -> str:
        return f"list_append({items}, {item})"

    def last(self, items: str) -> str:
        return f"({items})[-1]"

    def first(self, items: str) -> str:
        return f"({items})[1]"

    def struct(self, **fields: str) -> str:
        return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in fields.items()) + ")"

    def gather(self, item: str) -> str:
        return f"list_sort(list({item}))"

    def empty(self, kind: str) -> str:
        return f"CAST([] AS {kind}[])"

    def half_even(self, x: str) -> str:
        return f"CAST(round_even({x}, 0) AS INT)"

    def whole(self, x: str) -> str:
        return f"round_even({x}, 0)"

    def strings(self, item: str) -> str:
        return f"array_to_string(list_sort(list(DISTINCT {item})), ',')"

    def explode(self, relation: str, columns: str, items: str, alias: str) -> str:
        return f"SELECT {columns}, unnest({items}) AS {alias} FROM {relation}"

    def json(self, column: str, path: str) -> str:
        return f"json_extract_string({column}, '$.{path}')"
