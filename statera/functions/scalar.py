"""Parsing, normalising and comparing of amounts, dates and references. All native; what doesn't parse is NULL, never an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from statera.constants import DECAY_DAYS, GRACE_DAYS, GRAMMARS, PRIMARY_REFERENCES, VIN_VALUES, VIN_WEIGHTS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c) -> Column:
    return F.regexp_replace(_col(c), r"^\s+|\s+\z", "")


def _let(value: Column, body) -> Column:
    """body(value), with value made once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def amount_cents(c) -> Column:
    """Text to cents, HALF_UP: one pair of {} or [] around, (x) or a trailing or leading minus is negative (they don't cancel); $, comma
    and blanks go; at most 20 characters are left. Digits with two places, as most amounts are written, are read without all that."""
    c = _col(c)

    def signed(t, inner, bare):
        negative = t.rlike(r"(?s)^\(.*\)\z") | inner.endswith("-") | bare.startswith("-")
        digits = F.regexp_extract(bare, r"^-?((?=.{1,20}\z)(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))\z", 1)
        cents = (F.round(F.nullif(digits, F.lit("")).try_cast("decimal(38,19)"), 2) * 100).try_cast("bigint")
        return cents * F.when(negative, -1).otherwise(1)

    def bared(t, inner):
        return _let(F.translate(F.regexp_replace(inner, r"-\z", ""), "$, ", ""), lambda bare: signed(t, inner, bare))

    t = stripped(F.regexp_replace(stripped(c), r"(?s)^\{(.*)\}\z|^\[(.*)\]\z", "$1$2"))
    other = _let(t, lambda t: _let(F.regexp_replace(t, r"(?s)^\((.*)\)\z", "$1"), lambda inner: bared(t, inner)))
    return F.when(c.rlike(r"^\$?[0-9][0-9,]{0,14}\.[0-9]{2}\z"), F.translate(c, "$,.", "").try_cast("bigint")).otherwise(other)


def format_cents(c) -> Column:
    c = _col(c)
    whole, rest = F.call_function("div", F.abs(c), F.lit(100)).cast("string"), F.lpad((F.abs(c) % 100).cast("string"), 2, "0")
    return F.concat(F.when(c < 0, "-").otherwise(""), whole, F.lit("."), rest)


def parse_date(c) -> Column:
    """M/D/YYYY, YYYY-M-D or D-MMM-YYYY. Digits in the full width of the first two are read without taking the text apart."""
    c = _col(c)
    months = F.create_map(*[F.lit(x) for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1) for x in (m, f"{i:02d}")])
    us, iso, mon = r"^(\d{1,2})/(\d{1,2})/(\d{4})\z", r"^(\d{4})-(\d{1,2})-(\d{1,2})\z", r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})\z"
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    def other(t):
        part = lambda p, i: F.regexp_extract(t, p, i)
        month = F.try_element_at(months, F.lower(part(mon, 2)))
        return (
            F.when(t.rlike(us), day(part(us, 3), part(us, 1), part(us, 2)))
            .when(t.rlike(iso), day(part(iso, 1), part(iso, 2), part(iso, 3)))
            .when(t.rlike(mon) & month.isNotNull(), day(part(mon, 3), month, part(mon, 1)))
        )

    turned = F.concat(F.substring(c, 7, 4), F.lit("-"), F.substring(c, 1, 2), F.lit("-"), F.substring(c, 4, 2))
    return (
        F.when(c.rlike(r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}\z"), c.try_cast("date"))
        .when(c.rlike(r"^[0-9]{2}/[0-9]{2}/[1-9][0-9]{3}\z"), turned.try_cast("date"))
        .otherwise(_let(stripped(c), other))
    )


def plausible_date(c) -> Column:
    return F.get(F.filter(F.array(parse_date(c)), lambda d: F.year(d).between(1990, 2100)), F.lit(0))


def strip_control(c) -> Column:
    return F.regexp_replace(_col(c), r"[\x00-\x08\x0A-\x1F]", "")


def reference(c) -> Column:
    """Dashes, blanks and leading zeros go; upper case."""
    return F.regexp_replace(F.upper(F.translate(_col(c), "- ", "")), "^0+", "")


def canonical_reference(c) -> Column:
    return F.regexp_replace(reference(c), "^([^0-9]*)0+", "$1")


def canonical_text(c) -> Column:
    return F.lower(stripped(F.regexp_replace(_col(c), r"\s+", " ")))


def header_key(c) -> Column:
    return F.lower(F.regexp_replace(stripped(strip_control(c)), r"^[^A-Za-z0-9]+", ""))


def vin_ok(c) -> Column:
    v = _col(c)
    value = F.create_map(*[F.lit(x) for kv in VIN_VALUES.items() for x in kv])
    weight = F.array(*[F.lit(w) for w in VIN_WEIGHTS])
    parts = F.zip_with(F.split(v, ""), weight, lambda ch, w: F.when(w == 0, F.lit(0)).otherwise(F.try_element_at(value, ch) * w))
    rest = F.aggregate(parts, F.lit(0), lambda s, x: s + x) % 11
    digit = F.when(rest == 10, "X").otherwise(rest.cast("string"))
    return F.coalesce((F.length(v) == 17) & (F.substring(v, 9, 1) == digit), F.lit(False))


def grammar(name: str, c, oem=None) -> Column:
    """Whole match of the field's pattern: of one marque, or of any where oem is NULL."""
    c, known = _col(c), GRAMMARS[name]
    hit = {o: c.rlike(f"^(?:{p})\\z") for o, p in known.items()}
    anyone = reduce(lambda a, b: a | b, hit.values())
    if oem is None:
        return anyone
    out = F.when(_col(oem).isNull(), anyone)
    for o, m in hit.items():
        out = out.when(_col(oem) == o, m)
    return out.otherwise(F.lit(False))


def in_period(d, start, end, grace: int = GRACE_DAYS) -> Column:
    return _col(d).between(F.date_sub(_col(start), grace), F.date_add(_col(end), grace))


def sign_consistent(line_type, cents) -> Column:
    return F.when(_col(line_type) == "charge", _col(cents) > 0).when(_col(line_type) == "credit", _col(cents) < 0).otherwise(F.lit(True))


def ambiguity(c) -> Column:
    t = _col(c)
    return F.when(F.length(t) > 0, F.length(F.regexp_replace(t, "[^O0I1lS5B8Z2]", "")) / F.length(t)).otherwise(F.lit(0.0))


def plausible_residual(delta, cents) -> Column:
    off = _col(delta) + _col(cents)
    return (off != 0) & ((off > 0) == (_col(cents) > 0))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), _col(x)))))


def logit(p) -> Column:
    p = _col(p)
    inner = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.ln(p / (1 - p))))
    return F.when(p <= 0, -40.0).when(p >= 1, 40.0).otherwise(inner)


def within_one_edit(a, b) -> Column:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    a, b = _col(a), _col(b)
    swap = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: swap(i) == b)
    edits = F.levenshtein(a, b, 2)  # -1 beyond two
    return F.when(edits.between(0, 1), F.lit(True)).when((edits == 2) & (F.length(a) == F.length(b)), swapped).when(edits.isNotNull(), F.lit(False))


def vin_tail(a, b) -> Column:
    a, b = _col(a), _col(b)
    return (F.length(a) >= 8) & (F.length(b) >= 8) & (F.right(a, F.lit(8)) == F.right(b, F.lit(8)))


def primary_key(doc_type="doc_type", prefix: str = "") -> Column:
    """References of the document's type joined by a bar; NULL where any is missing."""
    part = lambda n: F.nullif(reference(prefix + n), F.lit(""))
    out = None
    for kind, names in PRIMARY_REFERENCES.items():
        key = part(names[0]) if len(names) == 1 else F.concat(part(names[0]), F.lit("|"), part(names[1]))
        out = F.when(_col(doc_type) == kind, key) if out is None else out.when(_col(doc_type) == kind, key)
    return out


def date_score(a, b) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.abs(F.datediff(_col(a), _col(b))) / F.lit(float(DECAY_DAYS)))


def amount_score(s, ledger) -> Column:
    s, ledger = _col(s), _col(ledger)
    return F.when(s == ledger, 1.0).when(F.abs(s - ledger) * 100 <= F.abs(ledger), 0.5).otherwise(0.0)


def field_correct(family, value, cents, day, truth, truth_cents, truth_day) -> Column:
    """NULL without a truth; amounts and dates by value, references and texts in canonical form."""
    family = _col(family)
    has = F.when(family == "amount", _col(truth_cents).isNotNull()).when(family == "date", _col(truth_day).isNotNull()).otherwise(_col(truth).isNotNull())
    same = (
        F.when(family == "amount", _col(cents).eqNullSafe(_col(truth_cents)))
        .when(family == "date", _col(day).eqNullSafe(_col(truth_day)))
        .when(family == "reference", canonical_reference(value).eqNullSafe(canonical_reference(truth)))
        .otherwise(canonical_text(value).eqNullSafe(canonical_text(truth)))
    )
    return F.when(has, same)


def rendered_key(line_no, name) -> Column:
    return F.when(_col(line_no).isNull(), F.concat(F.lit("header:"), _col(name))).otherwise(F.concat(_col(line_no).cast("string"), F.lit(":"), _col(name)))


def record_seed(seed: int, record_id) -> Column:
    """First eight bytes of SHA-256 of seed:id, big-endian, unsigned."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), _col(record_id)).cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def request_key(**parts) -> Column:
    """SHA-256 of the JSON object of parts, keys in order."""
    return F.sha2(F.to_json(F.struct(*[_col(parts[k]).alias(k) for k in sorted(parts)])), 256)


def token_estimate(text, images=0) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(_col(text)) / 4)) + 1500 * (F.lit(images) if isinstance(images, int) else _col(images))


def styled_amount(cents, style) -> Column:
    plain = format_cents(cents)
    grouped = F.format_number((F.abs(_col(cents)) / 100).cast("decimal(20,2)"), 2)
    dollars = F.concat(F.when(_col(cents) < 0, "-").otherwise(""), F.lit("$"), grouped)
    paren = F.when(_col(cents) < 0, F.concat(F.lit("("), format_cents(F.abs(_col(cents))), F.lit(")"))).otherwise(plain)
    return F.when(_col(style) == "dollar_comma", dollars).when(_col(style) == "paren", paren).otherwise(plain)


def styled_date(day, style) -> Column:
    day, us = _col(day), _col(style) == "us_slash"
    text = day.cast("date").cast("string")
    plain = F.when(us, F.concat(F.substring(text, 6, 2), F.lit("/"), F.substring(text, 9, 2), F.lit("/"), F.substring(text, 1, 4))).otherwise(text)
    # Years of other than four digits are left to the formatter.
    return F.when(F.length(text) == 10, plain).when(us, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))


def crop_url(doc_id, field_id) -> Column:
    quote = lambda c: F.replace(F.url_encode(_col(c)), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("/crops/"), quote(doc_id), F.lit("/"), quote(field_id))


def canonical_correction(family, text) -> Column:
    t = F.nullif(stripped(text), F.lit(""))
    return F.when(_col(family) == "amount", format_cents(amount_cents(t))).when(_col(family) == "date", parse_date(t).cast("string")).otherwise(t)


def list_price(prompt, completion, prompt_price, completion_price) -> Column:
    return F.coalesce(F.floor((_col(prompt) * _col(prompt_price) + _col(completion) * _col(completion_price) + 500000) / 1000000).cast("bigint"), F.lit(0).cast("bigint"))
