"""Reading request bodies: fields of a VARIANT with the JSON kind of the value kept in sight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def body(text: Column) -> Column:
    """A request body as a variant; NULL where it is not JSON, so that every field of it is missing."""
    return F.try_parse_json(text)


class Field:
    """One field of a body: whether it was sent, of which kind it is, and its value in several readings. Without a name, the body itself."""

    def __init__(self, parsed: Column, name: str | None = None) -> None:
        value = F.try_variant_get(parsed, "$" if name is None else f"$.{name}", "variant")
        self._hold(value, F.schema_of_variant(value))

    def _hold(self, value: Column, kind: Column) -> None:
        self.value, self.kind = value, kind
        self.sent = self.value.isNotNull()
        self.is_null = self.sent & F.is_variant_null(self.value)
        self.is_text = self.kind == "STRING"
        self.is_list = self.kind.startswith("ARRAY")
        self.is_flag = self.kind == "BOOLEAN"
        self.is_number = self.kind.isin("BIGINT", "DOUBLE") | self.kind.startswith("DECIMAL")
        self.is_object = self.kind.startswith("OBJECT")
        self._text = F.try_variant_get(value, "$", "string")
        self._long = F.try_variant_get(value, "$", "bigint")
        self._double = F.try_variant_get(value, "$", "double")
        self._flag = F.try_variant_get(value, "$", "boolean")
        self._list = F.try_variant_get(value, "$", "array<variant>")

    def found(self) -> Column:
        """The value and its kind, as a struct. ``at`` makes a field of it again."""
        return F.struct(self.value.alias("value"), self.kind.alias("kind"))

    @classmethod
    def at(cls, column: str) -> Field:
        """The field that a column holds as ``found``."""
        field = cls.__new__(cls)
        field._hold(F.col(f"{column}.value"), F.col(f"{column}.kind"))
        return field

    def truthy(self) -> Column:
        """False for null, false, zero, and empty text, list and object; NULL becomes false as well."""
        return F.coalesce(
            F.when(self.is_text, self._text != "")
            .when(self.is_flag, self._flag)
            .when(self.is_number, self._double != 0)
            .when(self.is_list, F.size(self._list) > 0)
            .when(self.is_object, self._text != "{}"),
            F.lit(False),
        )

    def text(self) -> Column:
        """Text as it is; other scalars as written in Python, NULL for null and when not sent. Lists and objects stay JSON."""
        whole = self.kind.startswith("DECIMAL") & self.kind.endswith(",0)") & self._long.isNotNull()  # a whole number with a point
        return F.when(self.is_flag, F.initcap(self._text)).when(whole, F.concat(self._text, F.lit(".0"))).otherwise(self._text)

    def text_or_falsy(self) -> Column:
        """Whether the value can be taken for a text: it is one, or is missing, null, false, zero or empty."""
        return F.coalesce(self.is_text, F.lit(False)) | ~self.truthy()

    def text_or_none(self) -> Column:
        """Like ``text``, with null turned into the text None."""
        return F.when(self.is_null, "None").otherwise(self.text())

    def int_text(self) -> Column:
        """A number cut to whole, a flag as 0 or 1, text as it is; anything else becomes unreadable text."""
        return F.when(self.is_text, self._text).when(
            self.sent, F.coalesce(F.when(self.is_number | self.is_flag, self._long.cast("string")), F.lit("None"))
        )

    def items(self) -> Column:
        """The elements of a list as text, in order; NULL for anything but a list."""
        return F.when(self.is_list, F.transform(self._list, _item_text))

    def text_items(self) -> Column:
        """The elements of a list that are texts, in order; empty text in place of the others."""
        text = lambda item: F.when(_kind(item) == "STRING", F.try_variant_get(item, "$", "string"))
        return F.when(self.is_list, F.transform(self._list, lambda item: F.coalesce(text(item), F.lit(""))))

    def int_items(self) -> Column:
        """The elements of a list as ``int_text``."""
        return F.when(self.is_list, F.transform(self._list, _item_int))


def read_bodies(rows: DataFrame, *names: str) -> tuple[DataFrame, Field, dict[str, Field]]:
    """Rows with their bodies read: the rows, the body itself as a field, and its fields of these names.

    ``inline`` of one struct keeps the optimizer from putting the parsing into every place where a field is asked for: a body is parsed once,
    and a field and its kind are found once a row.
    """
    parsed = rows.select("*", F.inline(F.array(F.struct(body(F.col("body")).alias("_parsed")))))
    columns = {name: f"_body_{name}" for name in ("", *names)}
    found = (Field(F.col("_parsed"), name or None).found().alias(column) for name, column in columns.items())
    whole, *fields = map(Field.at, columns.values())
    return parsed.select("*", F.inline(F.array(F.struct(*found)))).drop("_parsed"), whole, dict(zip(names, fields))


def object_or_falsy(whole: Field) -> Column:
    """Whether fields can be asked of a body: an object, or what counts as an empty one."""
    return F.coalesce(whole.is_object, F.lit(False)) | ~whole.truthy()


def texts_or_falsy(field: Field) -> Column:
    """Whether every element of a list can be taken for a text; true for anything but a list."""
    return F.coalesce(F.when(field.is_list, F.forall(field._list, _item_is_text)), F.lit(True))


def _item_is_text(item: Column) -> Column:
    kind, text = _kind(item), F.try_variant_get(item, "$", "string")
    empty = kind.isin("VOID", "STRING", "ARRAY<VOID>", "OBJECT<>") | (kind == "BOOLEAN") & (text == "false")
    return F.coalesce(empty | (F.try_variant_get(item, "$", "double") == 0), text.isNull())


def _kind(item: Column) -> Column:
    return F.schema_of_variant(item)


def _item_text(item: Column) -> Column:
    return F.coalesce(F.try_variant_get(item, "$", "string"), F.lit(""))


def _item_int(item: Column) -> Column:
    whole = F.when(_kind(item) != "STRING", F.try_variant_get(item, "$", "bigint").cast("string"))
    return F.coalesce(F.when(_kind(item) == "STRING", F.try_variant_get(item, "$", "string")), whole, F.lit(""))
