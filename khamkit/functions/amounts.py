"""Amounts in Thai words and national identity numbers, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits, places, and the words of money.
DIGITS = ("", "หนึ่ง", "สอง", "สาม", "สี่", "ห้า", "หก", "เจ็ด", "แปด", "เก้า")
PLACES = ("", "สิบ", "ร้อย", "พัน", "หมื่น", "แสน")
ZERO, MILLION, MINUS, BAHT, SATANG, EXACTLY = "ศูนย์", "ล้าน", "ลบ", "บาท", "สตางค์", "ถ้วน"
ONE_LAST, TWENTY = "เอ็ด", "ยี่สิบ"
MOST = (1 << 63) - 1


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def place_words(place: int) -> Column:
    """The words of each digit at a place of a group; a one at the end is settled by the caller."""
    words = [d + PLACES[place] if d else "" for d in DIGITS]
    if place == 1:
        words[1:3] = [PLACES[1], TWENTY]
    return F.array(*map(F.lit, words))


def group_words(group: Column, higher: Column) -> Column:
    """Words of 0 to 999,999; ``higher`` tells that a larger group comes before."""
    digit = lambda place: F.call_function("div", group, F.lit(10**place).cast("long")) % 10
    out = [F.element_at(place_words(place), (digit(place) + 1).cast("int")) for place in range(5, 0, -1)]
    last = F.when((digit(0) == 1) & ((group >= 10) | higher), ONE_LAST).otherwise(F.element_at(place_words(0), (digit(0) + 1).cast("int")))
    return F.concat(*out, last)


def number_words(value: Column) -> Column:
    """Words of a whole number of 0 or more. A group of six digits that is all zero says nothing, not even million."""

    def words(v: Column) -> Column:
        # From the largest group to the smallest: what is left of the number from it on.
        parts = F.transform(F.array(*[F.struct(F.lit(k > 0).alias("million"), F.call_function("div", v, F.lit(10 ** (6 * k)).cast("long")).alias("upto")) for k in range(3, -1, -1)]), one)
        return F.when(v == 0, ZERO).otherwise(F.array_join(parts, ""))

    def one(part: Column) -> Column:
        group = part["upto"] % 1_000_000
        return F.when(group > 0, F.concat(group_words(group, part["upto"] >= 1_000_000), F.when(part["million"], MILLION).otherwise(""))).otherwise("")

    return bound(value, words)


def money_words(baht: Column, satang: Column, negative: Column) -> Column:
    whole = F.when(baht > 0, F.concat(number_words(baht), F.lit(BAHT))).otherwise("")
    part = F.when(satang > 0, F.concat(number_words(satang), F.lit(SATANG))).otherwise(EXACTLY)
    return F.when((baht == 0) & (satang == 0), F.lit(ZERO + BAHT + EXACTLY)).otherwise(F.concat(F.when(negative, MINUS).otherwise(""), whole, part))


def bahttext(amount: Column | str) -> Column:
    """An amount in words, rounded half away from zero to satang; empty for NaN and infinities, null for null."""
    x = (F.col(amount) if isinstance(amount, str) else amount).cast("double")
    cents = F.round(F.abs(x) * 100, 0)
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    total = F.when(odd, F.lit(0).cast("long")).when(cents >= float(MOST), F.lit(MOST)).otherwise(cents.cast("long"))
    words = bound(total, lambda t: money_words(F.call_function("div", t, F.lit(100).cast("long")), t % 100, x < 0))
    return F.when(x.isNull(), F.lit(None).cast("string")).when(odd, "").otherwise(words)


def bahttext_str(text: Column | str) -> Column:
    """struct<value, error> of an amount written in digits; commas and spaces don't count, a third decimal rounds."""
    t = F.col(text) if isinstance(text, str) else text
    clean = F.translate(t, ", ", "")
    raw = F.regexp_replace(F.regexp_replace(clean, "^-+", ""), r"^\++", "")
    whole = F.split_part(raw, F.lit("."), F.lit(1))
    part = F.split_part(raw, F.lit("."), F.lit(2))
    stops = F.length(raw) - F.length(F.translate(raw, ".", ""))
    baht = F.when(whole == "", F.lit(0).cast("long")).otherwise(whole.try_cast("long"))
    up = F.when(F.substring(part, 3, 1) >= "5", 1).otherwise(0)
    satang = F.coalesce(F.rpad(F.substring(part, 1, 2), 2, "0").try_cast("long"), F.lit(0)) + up
    carried = baht + F.when((satang >= 100) & (baht < MOST), 1).otherwise(0)
    error = (
        F.when(clean == "", "Input string is empty")
        .when(stops > 1, "Invalid decimal format: multiple decimal points")
        .when(~whole.rlike("^[0-9]*$"), "Invalid characters in baht portion")
        .when(baht.isNull(), "Baht amount out of range")
        .when(~part.rlike("^[0-9]*$"), "Invalid characters in satang portion")
        .when((satang >= 100) & (baht == MOST), "Baht amount out of range")
    )
    parts = F.struct(carried.alias("baht"), (satang % 100).alias("satang"), clean.startswith("-").alias("negative"))
    value = bound(parts, lambda p: money_words(p["baht"], p["satang"], p["negative"]))
    return F.when(t.isNotNull(), F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error")))


def validate_id(text: Column | str) -> Column:
    """struct<is_valid, id, formatted, error> of a national identity number; all but ASCII digits is skipped."""
    t = F.col(text) if isinstance(text, str) else text

    def read(digits: Column) -> Column:
        # As one whole number, so that each digit is a division; null if there are not thirteen.
        return F.struct(digits.alias("digits"), F.when(F.length(digits) == 13, digits).try_cast("long").alias("number"))

    def summed(r: Column) -> Column:
        digit = lambda k: F.call_function("div", r["number"], F.lit(10 ** (12 - k)).cast("long")) % 10
        total = reduce(lambda a, b: a + b, (digit(k) * (13 - k) for k in range(12)))
        return F.struct(r["digits"].alias("digits"), ((11 - total % 11) % 10).alias("check"), digit(12).alias("last"))

    def told(r: Column) -> Column:
        digits, check, last = r["digits"], r["check"], r["last"]
        formatted = F.concat_ws("-", *[F.substring(digits, a, n) for a, n in ((1, 1), (2, 4), (6, 5), (11, 2), (13, 1))])
        length = F.concat(F.lit("Invalid length: expected 13 digits, found "), F.length(digits).cast("string"))
        checksum = F.concat(F.lit("Invalid checksum: expected check digit "), check.cast("string"), F.lit(", got "), last.cast("string"))
        return F.struct(
            F.coalesce(check == last, F.lit(False)).alias("is_valid"),
            F.when(check.isNotNull(), digits).otherwise(t).alias("id"),
            F.when(check.isNotNull(), formatted).alias("formatted"),
            F.when(check.isNull(), length).when(check != last, checksum).alias("error"),
        )

    judged = bound(bound(bound(F.regexp_replace(t, "[^0-9]", ""), read), summed), told)
    return F.when(t.isNotNull(), judged)
