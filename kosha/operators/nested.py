"""Merging inside arrays of structs, and records found in nested JSON, without taking rows apart and together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAST = "9999-99-99"  # entries without a date stand behind all others


def merge_events(existing: Column, overrides: Column, same) -> Column:
    """struct<merged, added, updated> of two arrays of structs with the fields `date` (yyyy-MM-dd or null) and `value`.

    An override takes the first entry of its date or becomes a new one; all
    other entries stay.  Of overrides of one date the last counts, those without
    a date don't.  merged is in order of dates, entries of one date as they
    stood; updated counts changes for which same(old, new) does not hold, so a
    second merge reports zeros.  Null arrays are empty.
    """
    def made(old, dates, last, by_date):
        takes = lambda x, i: x["date"].isNotNull() & (F.array_position(dates, x["date"]) == i + 1) & F.map_contains_key(by_date, x["date"])
        changes = lambda x, i: F.coalesce(takes(x, i), F.lit(False)) & ~F.coalesce(same(x["value"], by_date[x["date"]]), F.lit(False))
        kept = F.transform(old, lambda x, i: F.struct(x["date"].alias("date"), F.when(changes(x, i), by_date[x["date"]]).otherwise(x["value"]).alias("value")))
        fresh = F.filter(last, lambda x: ~F.coalesce(F.array_contains(dates, x["date"]), F.lit(False)))
        placed = F.transform(F.concat(kept, fresh), lambda x, i: F.struct(F.coalesce(x["date"], F.lit(LAST)).alias("k"), i.alias("i"), x.alias("x")))
        merged = F.transform(F.array_sort(placed), lambda x: x["x"])
        return F.struct(merged.alias("merged"), F.size(fresh).alias("added"), F.size(F.filter(old, changes)).alias("updated"))

    def with_last(old, new, new_dates):
        last = F.filter(new, lambda x, i: ~F.array_contains(F.slice(new_dates, i + 2, F.size(new)), x["date"]))
        return _let(last, lambda last: _let(F.map_from_entries(F.transform(last, lambda x: F.struct(x["date"], x["value"]))), lambda by_date: _let(dates_of(old), lambda dates: made(old, dates, last, by_date))))

    dates_of = lambda xs: F.transform(xs, lambda x: x["date"])
    old, new = F.coalesce(existing, F.array().cast(_EVENTS)), F.filter(F.coalesce(overrides, F.array().cast(_EVENTS)), lambda x: x["date"].isNotNull())
    return _let(old, lambda old: _let(new, lambda new: _let(dates_of(new), lambda new_dates: with_last(old, new, new_dates))))


def _let(value: Column, f) -> Column:
    """f of a value that is made once: inside a function of an array's elements a column is made anew for each element, and so is all that it rests on."""
    return F.element_at(F.transform(F.array(value), f), 1)


_EVENTS = "array<struct<date string, value double>>"


def drop_near(events: Column, known: Column, days: int = 60) -> Column:
    """Events that are no second report of a known one: same value within `days` days of a known date, unless the date itself is known."""
    dates = F.transform(known, lambda k: k["date"])
    near = lambda x: F.exists(known, lambda k: (k["value"] == x["value"]) & (F.abs(F.date_diff(x["date"].cast("date"), k["date"].cast("date"))) <= days))
    return F.filter(events, lambda x: F.coalesce(F.array_contains(dates, x["date"]), F.lit(False)) | ~F.coalesce(near(x), F.lit(False)))


def merge_records(existing: Column, incoming: Column) -> Column:
    """struct<merged, added, changed> of two maps from period to record (a struct with the field `derived`).

    An incoming record is new, or takes the place of a derived one if it is not
    derived itself; stated records are never replaced.  Keys that only one side
    has are kept.  changed counts records that differ from those they replace,
    so a second merge reports zeros.
    """
    takes = lambda a, b: b.isNotNull() & (a.isNull() | (a["derived"] & ~b["derived"]))
    merged = F.map_zip_with(existing, incoming, lambda k, a, b: F.when(F.coalesce(takes(a, b), F.lit(False)), b).otherwise(a))
    both = F.map_values(F.map_zip_with(existing, incoming, lambda k, a, b: F.struct(a.alias("a"), b.alias("b"))))
    added = F.size(F.filter(both, lambda x: x["a"].isNull() & x["b"].isNotNull()))
    changed = F.size(F.filter(both, lambda x: F.coalesce(x["a"].isNotNull() & takes(x["a"], x["b"]) & ~x["a"].eqNullSafe(x["b"]), F.lit(False))))
    return F.struct(merged.alias("merged"), added.alias("added"), changed.alias("changed"))


# What a live feed calls the fields of a security, first name first.
LIVE_FIELDS = {
    "isin": ("isin", "ISIN", "securityISIN", "securityIsin"),
    "name": ("name", "AN", "security_name", "securityName", "desc", "security"),
    "coupon": ("coupon", "couponRate", "interest", "rate"),
    "maturity_date": ("maturity", "maturityDate", "maturity_date", "matDate"),
    "price": ("price", "lastPrice", "last_price", "px", "close"),
    "ytm": ("ytm", "yield", "YTM", "lastYield"),
    "issuer": ("issuer", "AN", "issuerName"),
    "rating": ("rating", "creditRating"),
    "segment": ("segment", "sector", "type"),
}

_NODES = "array<map<string, variant>>"


def find_records(json: Column, fields: dict[str, tuple[str, ...]] = LIVE_FIELDS, key: str = "isin", depth: int = 6, deeper: str = "raise") -> Column:
    """array of structs, one for each object with a field called `key` (in any case), wherever it is nested in objects.

    A record has the first present alias of every field, as text; those without
    a value of `key` are left out, and objects inside a record are not looked
    at.  Arrays and plain values are not entered.  The top object has depth 0;
    if objects below `depth` are left, deeper="raise" fails and deeper="skip"
    leaves them out.  Null and malformed texts give no records.
    """
    node = F.try_parse_json(json).try_cast("map<string, variant>")
    level = F.filter(F.array(node), lambda m: m.isNotNull())
    is_record = lambda m: F.exists(F.map_keys(m), lambda k: F.lower(k) == key)
    found = F.array().cast(_NODES)
    for _ in range(depth + 1):
        found = F.concat(found, F.filter(level, is_record))
        inner = F.flatten(F.transform(F.filter(level, lambda m: ~is_record(m)), lambda m: F.map_values(m)))
        level = F.filter(F.transform(inner, lambda v: v.try_cast("map<string, variant>")), lambda m: m.isNotNull())
    if deeper == "raise":
        found = F.when(F.size(level) > 0, F.raise_error(F.lit(f"objects are nested more than {depth} deep")).cast(_NODES)).otherwise(found)

    def field(m, names):
        value = F.lit(None).cast("string")
        for n in reversed(names):
            value = F.when(F.map_contains_key(m, F.lit(n)), F.try_element_at(m, F.lit(n)).try_cast("string")).otherwise(value)
        return value

    records = F.transform(found, lambda m: F.struct(*[field(m, names).alias(name) for name, names in fields.items()]))
    return F.filter(records, lambda r: F.coalesce(r[key] != "", F.lit(False)))
