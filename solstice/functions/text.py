"""Plain-language statements (H8-H11), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def window_label(w) -> Column:
    """day / week / 30-day period / year / N-day period (H8)."""
    x = _c(w)
    return (F.when(x == 1, F.lit("day"))
            .when(x == 7, F.lit("week"))
            .when(x == 30, F.lit("30-day period"))
            .when(x == 365, F.lit("year"))
            .otherwise(F.concat(x.cast("string"), F.lit("-day period"))))


def _comparative(d: Column) -> Column:
    return (F.when(d == "warm", F.lit("warmer")).when(d == "cold", F.lit("colder"))
            .when(d == "wet", F.lit("wetter")).when(d == "dry", F.lit("drier"))
            .otherwise(F.lit("different")))


def _adverb(s: Column) -> Column:
    return F.when(s == "extreme", F.lit("extremely")).when(s == "unusual", F.lit("unusually")).otherwise(F.lit(""))


def _adjective(d: Column) -> Column:
    return F.when(d == "neutral", F.lit("")).otherwise(d)


def primary_statement(window_days, sev, dirn, record_type=None) -> Column:
    """record > normal > insufficient > a bit > adverb + adjective (H9)."""
    label = window_label(window_days)
    s, d = _c(sev), _c(dirn)
    adv, adj = _adverb(s), _adjective(d)
    body = (F.when(s == "normal", F.concat(F.lit("This "), label, F.lit(" is near normal.")))
            .when(s == "insufficient_data",
                  F.concat(F.lit("Not enough climatology data to classify this "), label, F.lit(".")))
            .when(s == "a_bit", F.concat(F.lit("This "), label, F.lit(" is a bit "), _comparative(d), F.lit(".")))
            .when(adv != "", F.concat(F.lit("This "), label, F.lit(" is "), adv, F.lit(" "), adj, F.lit(".")))
            .otherwise(F.concat(F.lit("This "), label, F.lit(" is "), adj, F.lit("."))))
    if record_type is None:
        return body
    rt = _c(record_type)
    return F.when(rt.isNotNull(), F.concat(F.lit("This "), label, F.lit(" is the "), rt, F.lit(" on record."))).otherwise(body)


def _pct0(x: Column) -> Column:
    # Python "{:.0f}": round half to even on the binary value; format_number does the same.
    return F.regexp_replace(F.format_number(x, 0), ",", "")


def supporting_line(window_days, pct, dirn, coverage_years, first_year, since_year=None,
                    current_year=None) -> Column:
    """"Colder than N% of historical weeks (since 1990, 30 years of data)." (H10).

    ``pct`` null reads as 50 (fix Q6: only a missing percentile falls back).
    """
    label = window_label(window_days)
    p = F.coalesce(_c(pct), F.lit(50.0))
    d = _c(dirn)
    wetdry = d.isin("wet", "dry")
    comp = (F.when(p <= 50, F.concat(F.when(wetdry, F.lit("Drier")).otherwise(F.lit("Colder")),
                                     F.lit(" than "), _pct0(100 - p), F.lit("%")))
            .otherwise(F.concat(F.when(wetdry, F.lit("Wetter")).otherwise(F.lit("Warmer")),
                                F.lit(" than "), _pct0(p), F.lit("%"))))
    since_label = F.concat(F.lit("since "), _c(first_year).cast("string"))
    if since_year is not None:
        sy = _c(since_year)
        rng = F.when(sy.isNotNull(), F.concat(sy.cast("string"), F.lit("–"), _c(current_year).cast("string"))
                     ).otherwise(since_label)
    else:
        rng = since_label
    return F.concat(comp, F.lit(" of historical "), label, F.lit("s ("), rng, F.lit(", "),
                    _c(coverage_years).cast("string"), F.lit(" years of data)."))


def period_label(w) -> Column:
    """Card vocabulary: day, week, two-week period, month, quarter, year (H8)."""
    x = _c(w)
    return (F.when(x == 1, F.lit("day")).when(x == 7, F.lit("week"))
            .when(x == 14, F.lit("two-week period")).when(x == 30, F.lit("month"))
            .when(x == 90, F.lit("quarter")).when(x == 365, F.lit("year"))
            .otherwise(F.concat(x.cast("string"), F.lit("-day period"))))


def days_label(w) -> Column:
    x = _c(w)
    return F.when(x == 1, F.lit("day")).otherwise(F.concat(x.cast("string"), F.lit(" days")))


def headline(window_days, sev, pct, seasonal_rank, total_years) -> Column:
    """Card headline.

    Side comes from the percentile (<= 50 is cold).  Seasonal record when the
    current period ranks 1st of >= 10 years and the severity is a_bit or
    stronger; normal / insufficient read "near normal".
    """
    s, p = _c(sev), _c(pct)
    cold = p.isNotNull() & (p <= 50)
    side = F.when(cold, F.lit("cold")).otherwise(F.lit("warm"))
    styled = s.isin("extreme", "unusual", "a_bit")
    days = days_label(window_days)
    head = F.concat(F.lit("The last "), days, F.lit(" have been "))
    record = F.coalesce((_c(seasonal_rank) == 1) & (_c(total_years) >= 10), F.lit(False))
    return (F.when(record & styled,
                   F.concat(head, F.lit("the "), F.when(cold, F.lit("coldest")).otherwise(F.lit("warmest")),
                            F.lit(" "), period_label(window_days), F.lit(" for this time of year in "),
                            _c(total_years).cast("string"), F.lit(" years.")))
            .when(~styled, F.concat(head, F.lit("near normal.")))
            .when(s == "a_bit", F.concat(head, F.lit("a bit "),
                                         F.when(cold, F.lit("colder")).otherwise(F.lit("warmer")), F.lit(".")))
            .otherwise(F.concat(head, F.when(s == "extreme", F.lit("extremely ")).otherwise(F.lit("unusually ")),
                                side, F.lit("."))))
