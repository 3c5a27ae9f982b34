"""Queries over scalar functions, with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from statera.constants import GRAMMARS, PRICES, VIN_VALUES, VIN_WEIGHTS
from statera.functions import scalar as S
from statera.operators.costs import effective, priced
from statera.plans.base import book
from statera.plans.views import load, with_views

QUERIES, ORACLE_SQL, query = book()


def _expr(name: str, view: str, key: str, column, sql: str, extra: str = "*"):
    """A query that shows one expression next to its row's key."""

    def run(spark, d):
        rows = load(spark, d, view)
        return (rows if extra == "*" else rows.selectExpr("*", extra)).select(key, column().alias("result"))

    QUERIES[name] = run
    more = "*" if extra == "*" else f"*, {extra}"
    body = f"SELECT {key}, {sql} AS result FROM (SELECT {more} FROM {view}) q"
    ORACLE_SQL[name] = with_views(body, view) if view in ("ledger", "fields", "statement_lines", "llm_calls", "corrections", "samples") else body


#: What an amount reads as, step by step as the parser takes it.
_AMOUNT = """
CASE WHEN regexp_full_match(raw_text, ' *[0-9.$,()-]+ *') THEN
  CASE WHEN raw_text LIKE '(%)' OR trim(raw_text) LIKE '%-' THEN -1 ELSE 1 END
  * CAST(round(TRY_CAST(replace(regexp_replace(raw_text, '[()$, -]', '', 'g'), ' ', '') AS DECIMAL(38, 10)), 2) * 100 AS BIGINT) END
"""
_DATE = """
CASE WHEN regexp_full_match(raw_text, '[0-9]{2}/[0-9]{2}/[0-9]{4}') THEN TRY_CAST(substr(raw_text, 7, 4) || '-' || substr(raw_text, 1, 2) || '-' || substr(raw_text, 4, 2) AS DATE)
  WHEN regexp_full_match(raw_text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(raw_text AS DATE) END
"""
_REFERENCE = "regexp_replace(upper(replace(replace({}, '-', ''), ' ', '')), '^0+', '')"
_CENTS = "(CASE WHEN {0} < 0 THEN '-' ELSE '' END || (abs({0}) // 100)::VARCHAR || '.' || lpad((abs({0}) % 100)::VARCHAR, 2, '0'))"

_expr("op_F1_parse_amount", "fields", "field_id", lambda: F.when(F.col("family") == "amount", S.amount_cents("raw_text")), f"CASE WHEN family = 'amount' THEN {_AMOUNT} END")
_expr("op_F2_format_cents", "ledger", "entry_id", lambda: S.format_cents("c"), _CENTS.format("c"), "amount_cents - 5000000 AS c")
_expr("op_F3_parse_date", "fields", "field_id", lambda: F.when(F.col("family") == "date", S.parse_date("raw_text")), f"CASE WHEN family = 'date' THEN {_DATE} END")
_expr("op_F4_strip_control", "documents", "doc_id", lambda: F.md5(S.strip_control("text").cast("binary")), r"md5(regexp_replace(text, '[\x00-\x08\x0A-\x1F]', '', 'g'))")
_expr("op_F5_normalize_reference", "ledger", "entry_id", lambda: S.reference("r"), _REFERENCE.format("r"), "concat('00-', lower(coalesce(claim_number, '0')), ' ') AS r")
_expr("op_F6_canonical_reference", "ledger", "entry_id", lambda: S.canonical_reference("claim_number"), f"regexp_replace({_REFERENCE.format('claim_number')}, '^([^0-9]*)0+', '\\1')")
_expr("op_F7_canonical_text", "documents", "doc_id", lambda: F.md5(S.canonical_text("t").cast("binary")), r"md5(lower(trim(regexp_replace(t, '\s+', ' ', 'g'))))", "concat('  ', coalesce(text, ''), ' ') AS t")
_vin_map = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in VIN_VALUES.items()) + "}"
_vin_sum = " + ".join(f"coalesce({_vin_map}[substr(v, {i + 1}, 1)], 100000) * {w}" for i, w in enumerate(VIN_WEIGHTS) if w)
_expr("op_F8_vin_check_digit", "ledger", "entry_id", lambda: S.vin_ok("v"), f"length(v) = 17 AND substr(v, 9, 1) = CASE ({_vin_sum}) % 11 WHEN 10 THEN 'X' ELSE (({_vin_sum}) % 11)::VARCHAR END", "concat(substr(vin, 1, 8), CAST(l_partkey % 10 AS STRING), substr(vin, 10, 8)) AS v")
_any = " OR ".join(f"regexp_full_match(invoice_number, '{p}')" for p in GRAMMARS["invoice_number"].values())
_expr("op_F9_grammar_match", "ledger", "entry_id", lambda: S.grammar("invoice_number", "invoice_number"), _any)


@query("op_F10_date_within_period", "SELECT entry_id, post_date BETWEEN DATE '1997-03-01' - 60 AND DATE '1997-03-31' + 60 AS result FROM ledger", "ledger")
def f10(spark, d):
    day = lambda s: F.lit(s).cast("date")
    return load(spark, d, "ledger").select("entry_id", S.in_period("post_date", day("1997-03-01"), day("1997-03-31")).alias("result"))


_expr("op_F11_sign_consistent", "ledger", "entry_id", lambda: S.sign_consistent("t", F.col("amount_cents") - 5000000), "CASE t WHEN 'charge' THEN amount_cents > 5000000 WHEN 'credit' THEN amount_cents < 5000000 ELSE true END", "CASE l_partkey % 3 WHEN 0 THEN 'charge' WHEN 1 THEN 'credit' ELSE 'payment' END AS t")
_expr("op_A24_char_ambiguity", "ledger", "entry_id", lambda: F.round(S.ambiguity("vin"), 9), "round(length(regexp_replace(vin, '[^O0I1lS5B8Z2]', '', 'g'))::DOUBLE / length(vin), 9)")
_expr("op_F12_field_correct", "fields", "field_id", lambda: S.field_correct(F.lit("reference"), "raw_text", F.lit(None), F.lit(None), "truth", F.lit(None), F.lit(None)), f"CASE WHEN truth IS NOT NULL THEN regexp_replace({_REFERENCE.format('raw_text')}, '^([^0-9]*)0+', '\\1') IS NOT DISTINCT FROM regexp_replace({_REFERENCE.format('truth')}, '^([^0-9]*)0+', '\\1') END", "CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 7 = 0 THEN concat('X', raw_text) ELSE lower(raw_text) END AS truth")
_expr("op_F13_raw_correct", "fields", "field_id", lambda: F.when(F.col("printed").isNotNull(), F.coalesce(F.col("printed") == F.col("raw_text"), F.lit(False))), "CASE WHEN printed IS NOT NULL THEN coalesce(printed = raw_text, false) END", "CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 7 = 0 THEN concat('X', raw_text) ELSE raw_text END AS printed")
_expr("op_F14_rendered_key", "fields", "field_id", lambda: S.rendered_key("n", "name"), "CASE WHEN n IS NULL THEN 'header:' || name ELSE n || ':' || name END", "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE line_no END AS n")
_expr("op_F15_plausible_residual", "ledger", "entry_id", lambda: S.plausible_residual("delta", "amount_cents"), "delta + amount_cents <> 0 AND ((delta + amount_cents > 0) = (amount_cents > 0))", "(l_partkey % 7 - 3) * 2000000 AS delta")
_expr("op_F16_sigmoid", "ledger", "entry_id", lambda: F.round(S.sigmoid("x"), 9), "round(1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(-40.0::DOUBLE, least(40.0::DOUBLE, x)))), 9)", "CAST((l_partkey % 200 - 100) AS DOUBLE) / 2 AS x")
_expr("op_F17_logit", "samples", "field_id", lambda: F.round(S.logit(F.col("confidence").cast("double")), 6), "round(CASE WHEN confidence <= 0 THEN -40.0::DOUBLE WHEN confidence >= 1 THEN 40.0::DOUBLE ELSE greatest(-40.0::DOUBLE, least(40.0::DOUBLE, ln(confidence::DOUBLE / (1 - confidence::DOUBLE)))) END, 6)")


@query("op_F18_within_one_edit", "SELECT entry_id, damerau_levenshtein(a, b) <= 1 AS result FROM (SELECT entry_id, invoice_number AS a, CASE l_partkey % 4 WHEN 0 THEN concat(substr(invoice_number, 1, 5), substr(invoice_number, 7, 1), substr(invoice_number, 6, 1), substr(invoice_number, 8, 1)) WHEN 1 THEN substr(invoice_number, 2, 7) WHEN 2 THEN concat('Z', substr(invoice_number, 2, 5), 'Q', substr(invoice_number, 8, 1)) ELSE concat(invoice_number, '7') END AS b FROM ledger) x", "ledger")
def f18(spark, d):
    a, part = F.col("invoice_number"), lambda i, n: F.substring("invoice_number", i, n)
    b = F.when(F.col("l_partkey") % 4 == 0, F.concat(part(1, 5), part(7, 1), part(6, 1), part(8, 1))).when(F.col("l_partkey") % 4 == 1, part(2, 7))
    b = b.when(F.col("l_partkey") % 4 == 2, F.concat(F.lit("Z"), part(2, 5), F.lit("Q"), part(8, 1))).otherwise(F.concat(a, F.lit("7")))
    return load(spark, d, "ledger").select("entry_id", a.alias("a"), b.alias("b")).select("entry_id", S.within_one_edit("a", "b").alias("result"))


_expr("op_F19_vin_tail", "ledger", "entry_id", lambda: S.vin_tail("vin", "other"), "length(vin) >= 8 AND length(other) >= 8 AND right(vin, 8) = right(other, 8)", "CASE WHEN l_partkey % 2 = 0 THEN concat('ZZ', substr(vin, 3, 15)) ELSE concat(substr(vin, 1, 16), 'Z') END AS other")


@query("op_F20_header_key", "SELECT p_partkey, lower(p_name) AS result FROM part")
def f20(spark, d):
    return load(spark, d, "part").select("p_partkey", S.header_key(F.concat(F.lit("# \t"), "p_name", F.lit(" "))).alias("result"))


_expr("op_F21_canonical_correction", "fields", "field_id", lambda: S.canonical_correction("family", "raw_text"), f"CASE family WHEN 'amount' THEN {_CENTS.format('(' + _AMOUNT + ')')} WHEN 'date' THEN ({_DATE})::VARCHAR ELSE trim(raw_text) END")
_expr("op_F22_request_key", "llm_calls", "call_id", lambda: S.request_key(model="model", provider="provider", tokens="prompt_tokens"), """sha256('{"model":"' || model || '","provider":"' || provider || '","tokens":' || prompt_tokens || '}')""")
_expr("op_F23_record_seed", "ledger", "entry_id", lambda: S.record_seed(42, "entry_id").cast("string"), "(('0x' || substr(sha256('42:' || entry_id), 1, 16))::UBIGINT)::VARCHAR")
_expr("op_F24_config_hash", "llm_calls", "call_id", lambda: S.request_key(run_id="run_id"), """sha256('{"run_id":"' || run_id || '"}')""")
_expr("op_F25_token_estimate", "conversations", "k", lambda: S.token_estimate("text", F.col("turn")).cast("bigint"), "greatest(1, length(text) // 4) + 1500 * turn", "concat(CAST(conv_id AS STRING), '/', CAST(turn AS STRING), '/', role) AS k")
_grouped = "CASE WHEN c < 0 THEN '-' ELSE '' END || '$' || regexp_replace(reverse(regexp_replace(reverse((abs(c) // 100)::VARCHAR), '([0-9]{3})', '\\1,', 'g')), '^,', '') || '.' || lpad((abs(c) % 100)::VARCHAR, 2, '0')"


@query("op_F26_format_styles", f"SELECT entry_id, CASE l_partkey % 3 WHEN 1 THEN {_grouped} WHEN 2 THEN CASE WHEN c < 0 THEN '(' || {_CENTS.format('abs(c)')} || ')' ELSE {_CENTS.format('c')} END ELSE {_CENTS.format('c')} END AS amount, CASE WHEN l_partkey % 2 = 0 THEN strftime(post_date, '%m/%d/%Y') ELSE strftime(post_date, '%Y-%m-%d') END AS day FROM (SELECT *, amount_cents - 5000000 AS c FROM ledger) x", "ledger")
def f26(spark, d):
    x = load(spark, d, "ledger").withColumn("c", F.col("amount_cents") - 5000000)
    style = F.when(F.col("l_partkey") % 3 == 1, "dollar_comma").when(F.col("l_partkey") % 3 == 2, "paren").otherwise("plain")
    return x.select("entry_id", S.styled_amount("c", style).alias("amount"), S.styled_date("post_date", F.when(F.col("l_partkey") % 2 == 0, "us_slash").otherwise("iso")).alias("day"))


@query("op_F27_crop_url", "SELECT p_partkey, '/crops/' || replace(p_name, ' ', '%20') || '/' || replace(replace(p_brand, '#', '%23'), ' ', '%20') AS result FROM part")
def f27(spark, d):
    return load(spark, d, "part").select("p_partkey", S.crop_url("p_name", "p_brand").alias("result"))


@query("op_F29_json_struct", """SELECT field_id, '{"family":"' || family || '","line_no":' || line_no || '}' AS text, line_no AS back FROM fields""", "fields")
def f29(spark, d):
    text = F.to_json(F.struct("family", "line_no"))
    return load(spark, d, "fields").select("field_id", text.alias("text"), F.from_json(text, "family string, line_no int")["line_no"].alias("back"))


@query("op_S5h_plausible_year", f"SELECT field_id, CASE WHEN year(x) BETWEEN 1990 AND 2100 THEN x END AS result FROM (SELECT field_id, {_DATE} AS x FROM fields) q", "fields")
def s5h(spark, d):
    return load(spark, d, "fields").select("field_id", S.plausible_date("raw_text").alias("result"))


@query("op_R4_truth_unpivot", "SELECT doc_id, line_no, name, value FROM (SELECT doc_id, line_no, claim_number, vin, program_code, CAST(amount_cents AS STRING) AS line_amount FROM statement_lines) UNPIVOT (value FOR name IN (claim_number, vin, program_code, line_amount))", "statement_lines")
def r4(spark, d):
    wide = load(spark, d, "statement_lines").select("doc_id", "line_no", "claim_number", "vin", "program_code", F.col("amount_cents").cast("string").alias("line_amount"))
    return wide.unpivot(["doc_id", "line_no"], ["claim_number", "vin", "program_code", "line_amount"], "name", "value").filter("value IS NOT NULL")


_price_rows = ", ".join(f"('{k}', {a}, {b}, {i})" for i, (k, (a, b)) in enumerate(PRICES.items()))
_PRICED = f"""
WITH p(pattern, pp, cp, pos) AS (VALUES {_price_rows}),
m AS (SELECT call_id, pp, cp, row_number() OVER (PARTITION BY call_id ORDER BY length(pattern) DESC, pos) AS i FROM llm_calls JOIN p ON contains(lower(model), pattern)),
c AS (SELECT l.*, coalesce((prompt_tokens * pp + completion_tokens * cp + 500000) // 1000000, 0) AS listed FROM llm_calls l LEFT JOIN (SELECT * FROM m WHERE i = 1) m USING (call_id))
"""


@query("op_A14_list_price", _PRICED + "SELECT call_id, listed FROM c", "llm_calls")
def a14(spark, d):
    return priced(load(spark, d, "llm_calls")).select("call_id", "listed")


@query("op_J22_longest_pattern", _PRICED + "SELECT call_id, pp, cp FROM m WHERE i = 1", "llm_calls")
def j22(spark, d):
    return priced(load(spark, d, "llm_calls")).filter("price IS NOT NULL").select("call_id", "price.pp", "price.cp")


@query("op_P16_effective_price", _PRICED + "SELECT call_id, CASE WHEN list_price_microusd <> 0 THEN list_price_microusd ELSE listed END AS price FROM c", "llm_calls")
def p16(spark, d):
    return effective(load(spark, d, "llm_calls")).select("call_id", F.col("effective").alias("price"))


for _n, _by in (("op_A10_cost_by_document", "doc_id"), ("op_A10_cost_by_provider", "provider")):

    @query(_n, _PRICED + f"SELECT {_by}, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt, sum(completion_tokens)::BIGINT AS completion, sum(listed)::BIGINT AS listed FROM c GROUP BY {_by}", "llm_calls")
    def _cost(spark, d, by=_by):
        return priced(load(spark, d, "llm_calls")).groupBy(by).agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"), F.sum("listed").alias("listed"))


@query("op_A11_distinct_models", "SELECT DISTINCT run_id, model FROM llm_calls", "llm_calls")
def a11(spark, d):
    return load(spark, d, "llm_calls").select("run_id", "model").distinct()


@query("op_A19_attempt_start", "SELECT run_id, min(seq) AS started FROM llm_calls GROUP BY run_id", "llm_calls")
def a19(spark, d):
    return load(spark, d, "llm_calls").groupBy("run_id").agg(F.min("seq").alias("started"))


@query("op_R5_attempt_models", "SELECT DISTINCT run_id, model FROM llm_calls l JOIN (SELECT run_id, avg(seq) AS s FROM llm_calls GROUP BY run_id) a USING (run_id) WHERE seq >= s", "llm_calls")
def r5(spark, d):
    calls = load(spark, d, "llm_calls")
    return calls.join(calls.groupBy("run_id").agg(F.avg("seq").alias("s")), "run_id").filter("seq >= s").select("run_id", "model").distinct()


@query("op_R22_failure_action", "SELECT call_id, CASE WHEN http_status = 429 THEN 'cooldown' WHEN http_status >= 500 THEN 'retry' WHEN http_status >= 400 THEN 'fail' ELSE 'ok' END AS action FROM llm_calls", "llm_calls")
def r22(spark, d):
    s = F.col("http_status")
    return load(spark, d, "llm_calls").select("call_id", F.when(s == 429, "cooldown").when(s >= 500, "retry").when(s >= 400, "fail").otherwise("ok").alias("action"))


@query("op_S18_failure_class", "SELECT call_id, CASE WHEN kind = 'provider_unavailable' OR kind = 'odd' THEN 'transient' ELSE 'permanent' END AS failure FROM (SELECT call_id, CASE seq % 4 WHEN 0 THEN 'truncated' WHEN 1 THEN 'provider_unavailable' WHEN 2 THEN 'empty' ELSE 'odd' END AS kind FROM llm_calls) x", "llm_calls")
def s18(spark, d):
    kind = F.when(F.col("seq") % 4 == 0, "truncated").when(F.col("seq") % 4 == 1, "provider_unavailable").when(F.col("seq") % 4 == 2, "empty").otherwise("odd")
    permanent = kind.isin("truncated", "encrypted", "empty", "unrecognized", "too_large")
    return load(spark, d, "llm_calls").select("call_id", F.when(permanent, "permanent").otherwise("transient").alias("failure"))
