"""Pattern detection said in DuckDB SQL, from the behaviour of each rule and not from its pattern.

Every position of a text is tried; a match is what an anchored pattern takes there, with one
character after it as its end. Of the positions that match, a rule takes the first, then the
first behind it, and so on; spans are then accepted rule by rule."""

from __future__ import annotations

W = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
S = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
ID = "[A-Z0-9-]"
DAY = r"\p{Nd}{1,4}[./-]\p{Nd}{1,2}[./-]\p{Nd}{1,4}"
STREET = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Boulevard|Blvd|Drive|Dr"

#: (type, any case, what may not come before, shape, what may not come after, condition on the value);
#: the shapes of cued types have a group, which is the value.
SHAPES = [
    ("EMAIL", False, rf"{W}.+-", rf"[{W}.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}", rf"{W}.-", "true"),
    ("IP_ADDRESS", False, f"{W}:", r"\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}", f"{W}:", "is_address"),
    ("BANK_ACCOUNT", False, W, r"[A-Z]{2}\p{Nd}{2}(?: ?[A-Z0-9]){11,30}", W, "true"),
    ("CREDIT_CARD", False, r"\p{Nd}", r"(?:\p{Nd}[ -]?){12,18}\p{Nd}", r"\p{Nd}", "is_card"),
    ("NATIONAL_ID", True, W, rf"NAT-{ID}{{4,}}|\p{{Nd}}{{3}}-\p{{Nd}}{{2}}-\p{{Nd}}{{4}}", W, "true"),
    ("MEDICAL_ID", True, W, f"(?:MED|MRN)[- :]{ID}{{4,}}", W, "true"),
    ("CUSTOMER_ID", True, W, f"(?:CUS|CUSTOMER)[- :]{ID}{{4,}}", W, "true"),
    ("EMPLOYEE_ID", True, W, f"(?:EMP|EMPLOYEE)[- :]{ID}{{3,}}", W, "true"),
    ("VEHICLE_ID", False, W, "[0-9A-HJ-NPR-Z]{17}|[A-Z]{1,3}-[A-Z0-9-]{3,10}", W, "true"),
    ("DATE_OF_BIRTH", True, "", rf"(?:date of birth|birth date|DOB|born){S}*(?:is|:|was)?{S}*({DAY})", "", "true"),
    ("USERNAME", True, "", rf"(?:username|user name){S}*(?:(?:is|:|=){S}*)?([A-Za-z0-9_.-]{{3,64}})", "", "lower(value) NOT IN ('caption', 'field', 'input', 'placeholder')"),
    ("ADDRESS", True, W, rf"\p{{Nd}}{{1,6}}{S}+[A-Za-z][A-Za-z .'-]{{1,60}}{S}+(?:{STREET})", W, "true"),
    ("PHONE_NUMBER", False, W, r"\+?\p{Nd}(?:[ ()-]*\p{Nd}){7,14}", r"\p{Nd}", "true"),
]

#: Types whose value follows a cue.
CUED = {"DATE_OF_BIRTH", "USERNAME"}
_DIGITS = "string_split(regexp_replace(value, '[^0-9]', '', 'g'), '')"
CHECKS = {
    "is_card": f"(len(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND (value LIKE '% %' OR list_sum(list_transform(list_reverse({_DIGITS}), lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT WHEN d::INT > 4 THEN 2 * d::INT - 9 ELSE 2 * d::INT END)) % 10 = 0))",
    "is_address": "CASE WHEN value LIKE '%.%' THEN regexp_full_match(value, '((0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(\\.|$)){4}') ELSE value NOT LIKE '%:::%' AND (value NOT LIKE ':%' OR value LIKE '::%') AND (value NOT LIKE '%:' OR value LIKE '%::')"
    " AND CASE len(string_split(value, '::')) WHEN 1 THEN len(string_split(value, ':')) = 8 WHEN 2 THEN len(list_filter(string_split(value, ':'), lambda g: g <> '')) <= 7 ELSE false END END",
}


def _branch(k: int, label: str, any_case: bool, before: str, shape: str, after: str, accept: str) -> str:
    flags, quoted = "(?i)" if any_case else "", shape.replace("'", "''")
    end = f"(?:[^{after}]|$)" if after else ""
    grouped = label in CUED
    # a birth cue that is an abbreviation stands alone
    alone = f"pos = 1 OR NOT regexp_matches(substr(text, pos - 1, 1), '[{before}]')" if before else f"NOT regexp_matches(m, '(?i)^DOB') OR pos = 1 OR NOT regexp_matches(substr(text, pos - 1, 1), '[{W}]')"
    return f"""SELECT doc_id, {k} AS p, '{label}' AS type, pos, len(m) AS n, value, {CHECKS.get(accept, accept)} AS ok FROM (
    SELECT doc_id, text, pos, m, CASE WHEN {grouped} THEN regexp_extract(m, '^{flags}{quoted}$', 1) ELSE m END AS value FROM (
      SELECT doc_id, text, pos, regexp_extract(substr(text, pos), '^{flags}({quoted}){end}', 1) AS m FROM (
        SELECT doc_id, text, unnest(range(1, len(text) + 1)) AS pos FROM documents WHERE regexp_matches(text, '{flags}{quoted}')) x) y
    WHERE m <> '' AND ({alone})) z"""


CANDIDATES = "\n  UNION ALL ".join(_branch(k, *s) for k, s in enumerate(SHAPES))

SPANS = f"""WITH RECURSIVE cand AS MATERIALIZED ({CANDIDATES}),
steps AS (
  SELECT doc_id, p, min(pos) AS pos FROM cand GROUP BY doc_id, p
  UNION ALL SELECT doc_id, p, following FROM (
    SELECT s.doc_id, s.p, (SELECT min(c.pos) FROM cand c WHERE c.doc_id = s.doc_id AND c.p = s.p AND c.pos >= s.pos + h.n) AS following FROM steps s JOIN cand h ON h.doc_id = s.doc_id AND h.p = s.p AND h.pos = s.pos) f
  WHERE following IS NOT NULL),
found AS (SELECT c.doc_id, c.type, c.pos - 1 + c.n - len(c.value) AS start, c.pos - 1 + c.n AS stop, c.value, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.p, c.pos) AS i FROM cand c JOIN steps USING (doc_id, p, pos) WHERE c.ok),
taken(doc_id, i, kept) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, []::STRUCT(start BIGINT, stop BIGINT, type VARCHAR, text VARCHAR)[] FROM found
  UNION ALL SELECT t.doc_id, f.i, CASE WHEN len(list_filter(t.kept, lambda k: k.start < f.stop AND f.start < k.stop)) > 0 THEN t.kept ELSE list_append(t.kept, {{'start': f.start, 'stop': f.stop, 'type': f.type, 'text': f.value}}) END
  FROM taken t JOIN found f ON f.doc_id = t.doc_id AND f.i = t.i + 1),
spans AS (SELECT doc_id, unnest(arg_max(kept, i)) AS s FROM taken GROUP BY doc_id)
"""

DETECTION = SPANS + "SELECT doc_id, s.start::INT AS start, s.stop::INT AS stop, s.type, s.text FROM spans"
RESPONSE = SPANS + """SELECT d.doc_id, '{"entities":[' || coalesce((SELECT string_agg('{"type":"' || s.type || '","text":' || to_json(s.text)::VARCHAR || '}', ',' ORDER BY s.start) FROM spans WHERE spans.doc_id = d.doc_id), '') || ']}' AS response FROM documents d"""
