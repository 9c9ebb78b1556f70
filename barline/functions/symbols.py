"""Security codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code prefixes per exchange; Beijing is asked first.
BEIJING = ["430", "830", "831", "832", "833", "835", "836", "837", "838", "839", "870", "871", "872", "873", "920"]
SHANGHAI = ["600", "601", "603", "605", "688", "689", "510", "511", "512", "513", "515"]


def _starts(code: Column, prefixes) -> Column:
    return code.rlike("^(" + "|".join(prefixes) + ")")


def normalize_symbol(raw: Column) -> Column:
    """``dddddd.SH`` / ``.SZ`` / ``.BJ``; NULL when no six-digit code can be read."""
    clean = raw.rlike(r"^[0-9]{6}\.(SH|SZ|BJ)$")
    text = F.regexp_replace(F.upper(F.trim(raw)), "[^0-9A-Z.]", "")
    head = F.substring_index(text, ".", 1)
    tail = F.regexp_extract(text, r"^[^.]*\.(.*)$", 1)
    digits = F.regexp_replace(text, "[^0-9]", "")
    market = F.when(_starts(digits, BEIJING), "BJ").when(_starts(digits, SHANGHAI), "SH").otherwise("SZ")
    named = tail.isin("SH", "SZ", "BJ") & (F.length(head) == 6)
    return F.when(clean, raw).when(named, F.concat_ws(".", head, tail)).when(F.length(digits) == 6, F.concat_ws(".", digits, market))


def exchange(symbol: Column) -> Column:
    return F.substring_index(symbol, ".", -1)


def code(symbol: Column) -> Column:
    return F.substring_index(symbol, ".", 1)


def market_prefixed(symbol: Column) -> Column:
    """``sh600000``"""
    return F.concat(F.lower(exchange(symbol)), code(symbol))


def numeric_id(symbol: Column) -> Column:
    """``1.600000`` for Shanghai, ``0.`` for the rest."""
    return F.concat(F.when(exchange(symbol) == "SH", "1.").otherwise("0."), code(symbol))


def board(symbol: Column) -> Column:
    c = code(symbol)
    return (
        F.when(c.startswith("688"), "STAR")
        .when(c.startswith("300"), "ChiNext")
        .when(c.rlike("^00[0-3]"), "MainBoard")
        .when(c.rlike("^(8|43)"), "BSE")
        .otherwise("MainBoard")
    )


def looks_special_treatment(name: Column) -> Column:
    return F.upper(name).contains("ST")
