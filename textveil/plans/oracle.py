"""DuckDB SQL for the scanner's queries, by another algorithm: every character position is
a candidate, a window from it is matched from its first character, neighbours are tested
one character at a time, and recursive queries pick spans, merge them and build texts."""

from __future__ import annotations

from ..operators.scan import MARKER

ALNUM = "[0-9A-Za-z]"
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def candidates(source: str, key: str, text: str, gate: str, window: int, regex: str, prev: str, end: str = "length(m)", where: str = "true", conf: str = "2", trim: str = "") -> str:
    """(key, s, e, conf) of places whose window matches; s and e count characters from 0.

    ``m`` is the match (``trim`` characters off its end), ``nxt`` the character after it.
    """
    match = f"regexp_extract(substr(t, p, {window}), '^(?:{regex})')"
    if trim:
        match = f"regexp_replace({match}, '{trim}+$', '')"
    return f"""
    SELECT k, p - 1 AS s, p - 1 + {end} AS e, {conf} AS conf FROM (
      SELECT *, substr(t, p + length(m), 1) AS nxt FROM (
        SELECT k, t, p, {match} AS m FROM (
          SELECT k, t, unnest(range(1, length(t) + 1)) AS p FROM (SELECT {key} AS k, {text} AS t FROM {source}) WHERE regexp_matches(t, '{gate}')
        ) WHERE {prev}
      ) WHERE m <> ''
    ) WHERE {where}"""


def before(cls: str) -> str:
    """The character before isn't in a class, or there is none."""
    return f"(p = 1 OR NOT regexp_matches(substr(t, p - 1, 1), '{cls}'))"


DIGITS = "length(regexp_replace(m, '[^0-9]', '', 'g'))"
DOTS = "length(regexp_replace(m, '[^.]', '', 'g'))"
LUHN = """(list_sum(list_transform(range(1, length(regexp_replace(m, '[^0-9]', '', 'g')) + 1), lambda i:
 CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(regexp_replace(m, '[^0-9]', '', 'g')), i, 1) AS INTEGER)
 ELSE (2 * CAST(substr(reverse(regexp_replace(m, '[^0-9]', '', 'g')), i, 1) AS INTEGER)) // 10 + (2 * CAST(substr(reverse(regexp_replace(m, '[^0-9]', '', 'g')), i, 1) AS INTEGER)) % 10 END)) % 10 = 0)"""
WORD = before(ALNUM)
SLASHES = "length(regexp_replace(m, '[^/\\\\]', '', 'g'))"
VALUE = "[^ \\t\\n\\r\\f\"'',;]{4,}"
HEAD = "[ \\t]*[=:][ \\t]*[\"'']?"

#: name -> (detector, category, greedy, arguments of candidates)
DETECTORS: dict[str, tuple[str, str, bool, dict]] = {
    "email": ("EMAIL", "pii", False, {"gate": "@", "window": 2000, "regex": "[A-Za-z0-9.+_-]+@[A-Za-z0-9.-]+", "prev": before("[A-Za-z0-9.+_-]"), "trim": "[.-]", "where": "regexp_matches(m, '@[^@]*[.][^.@]{2,}$') AND length(m) BETWEEN 5 AND 320"}),
    "phone": ("PHONE", "pii", True, {"gate": "[0-9]", "window": 30, "regex": "[+(0-9][0-9 .()-]*", "prev": WORD, "trim": "[^0-9]", "where": f"{DIGITS} BETWEEN 7 AND 15 AND length(m) >= 7 AND NOT ({DOTS} >= 2 AND NOT regexp_matches(m, '[^0-9.+]'))", "conf": f"CASE WHEN {DIGITS} >= 10 THEN 2 ELSE 1 END"}),
    "ipv4": ("IP", "pii", True, {"gate": "[0-9][.][0-9]", "window": 16, "regex": f"{OCTET}[.]{OCTET}[.]{OCTET}[.]{OCTET}", "prev": WORD, "where": f"NOT regexp_matches(nxt, '{ALNUM}')"}),
    "ipv6": ("IP", "pii", True, {"gate": ":", "window": 45, "regex": "(?:::)?[0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4}){0,8}", "prev": WORD, "where": "length(m) >= 6 AND (starts_with(m, '::') OR length(m) - length(replace(m, ':', '')) >= 2)", "conf": "1"}),
    "credit_card": ("CREDIT_CARD", "pii", True, {"gate": "[0-9]", "window": 25, "regex": "[0-9][0-9 -]*", "prev": WORD, "trim": "[^0-9]", "where": f"{DIGITS} BETWEEN 13 AND 19 AND NOT regexp_matches(nxt, '{ALNUM}') AND {LUHN}"}),
    "ssn": ("SSN", "pii", True, {"gate": "[0-9]-", "window": 11, "regex": "[0-9]{3}-[0-9]{2}-[0-9]{4}", "prev": WORD, "where": "NOT regexp_matches(m, '^(000|666|9)') AND substr(m, 5, 2) <> '00' AND substr(m, 8, 4) <> '0000' AND NOT regexp_matches(nxt, '[0-9]')"}),
    "path": ("PATH", "pii", True, {"gate": "[/\\\\]", "window": 4096, "regex": "[A-Za-z0-9/\\\\._~:-]+", "trim": "[/\\\\.]", "where": f"length(m) >= 4 AND {SLASHES} >= 2", "conf": f"CASE WHEN {SLASHES} >= 3 THEN 2 ELSE 1 END",
        "prev": f"((substr(t, p, 1) = '/' AND {before('[0-9A-Za-z:]')}) OR ((regexp_matches(substr(t, p, 3), '^[.][.]?/') OR substr(t, p, 2) = '~/') AND (p = 1 OR regexp_matches(substr(t, p - 1, 1), '[ \\t\\n\\f\\r=\"'']'))) OR (regexp_matches(substr(t, p, 3), '^[A-Za-z]:\\\\') AND {WORD}))"}),
    "aws_key": ("AWS_KEY", "secret", True, {"gate": "A[KBCS][IC]A", "window": 20, "regex": "(AKIA|ABIA|ACCA|ASIA)[0-9A-Za-z]{16}", "prev": WORD, "where": f"NOT regexp_matches(nxt, '{ALNUM}')"}),
    "bearer_token": ("BEARER_TOKEN", "secret", True, {"gate": "(?i)bearer ", "window": 2055, "regex": "(?i)bearer [A-Za-z0-9_.-]{20,}", "prev": WORD}),
    "jwt": ("JWT", "secret", True, {"gate": "eyJ", "window": 12300, "regex": "eyJ[A-Za-z0-9_-]*[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", "prev": WORD, "where": "length(m) BETWEEN 36 AND 4096 AND NOT regexp_matches(substr(t, p + length(m), 2), '^[.][A-Za-z0-9_-]')"}),
    "private_key": ("PRIVATE_KEY", "secret", True, {"gate": "-----BEGIN ", "window": 100000, "regex": "|".join(f"-----BEGIN {k}-----(?s:.)*?-----END {k}-----" for k in ("RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "DSA PRIVATE KEY", "PRIVATE KEY", "PGP PRIVATE KEY BLOCK")) + "|-----BEGIN ((RSA |EC |OPENSSH |DSA )?PRIVATE KEY|PGP PRIVATE KEY BLOCK)-----(?s:.)*", "prev": "true", "conf": "CASE WHEN regexp_matches(m, '-----END [A-Z ]+-----$') THEN 2 ELSE 1 END"}),
    "database_url": ("DATABASE_URL", "secret", True, {"gate": "://", "window": 2064, "regex": "(postgres(ql)?|mysql|mongodb([+]srv)?|rediss?|amqps?)://[^ \\t\\n\\r\\f\"''<>]*", "prev": WORD, "where": "length(m) >= 15", "conf": "CASE WHEN contains(m, '@') THEN 2 ELSE 1 END"}),
    "webhook_secret": ("WEBHOOK_SECRET", "secret", True, {"gate": "whs", "window": 4096, "regex": "wh(sec|sk)_[A-Za-z0-9_-]+", "prev": WORD, "where": "length(m) >= 20"}),
    "slack_token": ("SLACK_TOKEN", "secret", True, {"gate": "xox", "window": 4096, "regex": "xox[bpsaor]-[A-Za-z0-9-]+", "prev": WORD, "where": "length(m) >= 15"}),
    "github_token": ("GITHUB_TOKEN", "secret", True, {"gate": "gh[pousr]_|github_pat_", "window": 4096, "regex": "(gh[pousr]_|github_pat_)[A-Za-z0-9_]+", "prev": WORD, "where": "length(m) >= 15"}),
    "stripe_key": ("STRIPE_KEY", "secret", True, {"gate": "[spr]k_", "window": 4096, "regex": "[spr]k_(live|test)_[A-Za-z0-9_]+", "prev": WORD, "where": "length(m) >= 15"}),
}
#: keyword assignments: name -> (detector, keyword regex, condition on the character before)
ASSIGNMENTS = {
    "api_key": ("API_KEY", "(api_key|apikey|api-key|access_key|secret_key)", "true"),
    "password": ("PASSWORD", "(password|passwd|pass)", "true"),
    "generic_secret": ("GENERIC_SECRET", "(secret|token|credential|auth_key)", WORD),
}
CONFIDENCE = "CASE conf WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"


def greedy(cands: str) -> str:
    """Recursive query over candidates c: the leftmost, then the leftmost from its end on, and so on."""
    return f"""c AS ({cands}), g(k, x) AS (
      SELECT k, arg_min(struct_pack(s := s, e := e, conf := conf), s) FROM c GROUP BY k
      UNION ALL
      SELECT g.k, arg_min(struct_pack(s := c.s, e := c.e, conf := c.conf), c.s) FROM g JOIN c ON c.k = g.k AND c.s >= g.x.e GROUP BY g.k, g.x.s
    )"""


def detector_sql(name: str, source: str, key: str, text: str) -> str:
    """Findings of one detector: (key, detector, category, start_byte, end_byte, confidence)."""
    bytes_of = lambda x: f"CAST(strlen(left(d.{text}, {x})) AS BIGINT)"
    out = f"SELECT d.{key}, '{{}}' AS detector, '{{}}' AS category, {bytes_of('{0}')} AS start_byte, {bytes_of('{1}')} AS end_byte, {CONFIDENCE} AS confidence FROM r JOIN {source} d ON d.{key} = r.k"
    if name in ASSIGNMENTS:
        detector, keyword, prev = ASSIGNMENTS[name]
        regex = f"(?i){keyword}{HEAD}{VALUE}"
        cands = candidates(source, key, text, f"(?i){keyword}", 5000, regex, prev, conf=f"length(regexp_extract(m, '^(?i){keyword}{HEAD}'))")
        # conf carries the head's length through the greedy choice
        return f"WITH RECURSIVE {greedy(cands)}, r AS (SELECT k, x.s + x.conf AS s, x.e AS e, 1 AS conf FROM g) " + _findings(source, key, text, detector, "secret")
    detector, category, picks, args = DETECTORS[name]
    cands = candidates(source, key, text, **args)
    if not picks:
        return f"WITH r AS ({cands}) " + _findings(source, key, text, detector, category)
    return f"WITH RECURSIVE {greedy(cands)}, r AS (SELECT k, x.s AS s, x.e AS e, x.conf AS conf FROM g) " + _findings(source, key, text, detector, category)


def _findings(source, key, text, detector, category) -> str:
    at = lambda x: f"CAST(strlen(left(d.{text}, r.{x})) AS BIGINT)"
    return f"SELECT d.{key} AS {key}, '{detector}' AS detector, '{category}' AS category, {at('s')} AS start_byte, {at('e')} AS end_byte, {CONFIDENCE} AS confidence FROM r JOIN {source} d ON d.{key} = r.k"


ALL = ("aws_key", "bearer_token", "jwt", "private_key", "api_key", "database_url", "password", "webhook_secret", "slack_token", "github_token", "stripe_key", "generic_secret", "email", "phone", "ipv4", "ipv6", "credit_card", "ssn", "path")
PII = ("email", "phone", "ipv4", "ipv6", "credit_card", "ssn")


def merged_ctes(names=PII, source="documents", key="doc_id", text="text") -> str:
    """CTEs up to f(k, pos, s, e, det, conf): merged findings in character offsets."""
    ctes, parts = [], []
    for i, n in enumerate(names):
        if n in ASSIGNMENTS:
            _, keyword, prev = ASSIGNMENTS[n]
            args, picks = {"gate": f"(?i){keyword}", "window": 5000, "regex": f"(?i){keyword}{HEAD}{VALUE}", "prev": prev, "conf": f"length(regexp_extract(m, '^(?i){keyword}{HEAD}'))"}, True
        else:
            _, _, picks, args = DETECTORS[n]
        ctes.append(f"c{i} AS MATERIALIZED ({candidates(source, key, text, **args)})")
        if picks:
            ctes.append(f"""g{i}(k, x) AS (
              SELECT k, arg_min(struct_pack(s := s, e := e, conf := conf), s) FROM c{i} GROUP BY k
              UNION ALL
              SELECT g{i}.k, arg_min(struct_pack(s := c{i}.s, e := c{i}.e, conf := c{i}.conf), c{i}.s) FROM g{i} JOIN c{i} ON c{i}.k = g{i}.k AND c{i}.s >= g{i}.x.e GROUP BY g{i}.k, g{i}.x.s
            )""")
            parts.append(f"SELECT k, x.s {'+ x.conf' if n in ASSIGNMENTS else ''} AS s, x.e AS e, {1 if n in ASSIGNMENTS else 'x.conf'} AS conf, {i} AS det FROM g{i}")
        else:
            parts.append(f"SELECT k, s, e, conf, {i} AS det FROM c{i}")
    ctes.append(f"a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, e DESC, det) AS n FROM ({' UNION ALL '.join(parts)}))")
    wins = "(a.conf > m.conf OR (a.conf = m.conf AND a.e - a.s > m.e - m.s))"
    ctes.append(f"""m(k, n, grp, s, e, det, conf) AS (
      SELECT k, n, 1, s, e, det, conf FROM a WHERE n = 1
      UNION ALL
      SELECT a.k, a.n, CASE WHEN a.s < m.e THEN m.grp ELSE m.grp + 1 END,
        CASE WHEN a.s < m.e THEN m.s ELSE a.s END,
        CASE WHEN a.s < m.e THEN greatest(m.e, a.e) ELSE a.e END,
        CASE WHEN a.s < m.e AND NOT {wins} THEN m.det ELSE a.det END,
        CASE WHEN a.s < m.e AND NOT {wins} THEN m.conf ELSE a.conf END
      FROM m JOIN a ON a.k = m.k AND a.n = m.n + 1
    )""")
    labels = " ".join(f"WHEN {i} THEN '{(DETECTORS.get(n) or ASSIGNMENTS[n])[0]}'" for i, n in enumerate(names))
    ctes.append(f"f AS MATERIALIZED (SELECT k, grp - 1 AS pos, x.s AS s, x.e AS e, CASE x.det {labels} END AS detector, x.conf AS conf FROM (SELECT k, grp, arg_max(struct_pack(s := s, e := e, det := det, conf := conf), n) AS x FROM m GROUP BY k, grp))")
    return "WITH RECURSIVE " + ",\n".join(ctes)


def merged_sql(names=PII, source="documents", key="doc_id", text="text") -> str:
    sample = "CASE WHEN e - s <= 4 THEN repeat('*', CAST(e - s AS INTEGER)) ELSE concat(substr(d.{0}, s + 1, least(4, (e - s) // 4)), '***') END".format(text)
    return f"""{merged_ctes(names, source, key, text)}
    SELECT d.{key} AS {key}, CAST(pos AS BIGINT) AS pos, detector, CASE WHEN detector IN ('EMAIL', 'PHONE', 'IP', 'CREDIT_CARD', 'SSN', 'PATH') THEN 'pii' ELSE 'secret' END AS category, CAST(strlen(left(d.{text}, s)) AS BIGINT) AS start_byte, CAST(strlen(left(d.{text}, e)) AS BIGINT) AS end_byte,
      {CONFIDENCE} AS confidence, {sample} AS masked_sample, CAST(1 + length(left(d.{text}, s)) - length(replace(left(d.{text}, s), chr(10), '')) AS BIGINT) AS line
    FROM f JOIN {source} d ON d.{key} = f.k"""


def mask_sql(replacement: str | None = None, names=PII, source="documents") -> str:
    before, after = MARKER.split("{}")
    marker = f"'{replacement}'" if replacement is not None else f"concat('{before}', detector, '{after}')"
    return f"""{merged_ctes(names, source)},
    p AS (SELECT k, pos, e, concat(substr(d.text, lag_e + 1, s - lag_e), {marker}) AS piece FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY k ORDER BY pos), 0) AS lag_e FROM f) x JOIN {source} d ON d.doc_id = x.k),
    j AS (SELECT k, string_agg(piece, '' ORDER BY pos) AS head, max(e) AS e, count(*) AS n FROM p GROUP BY k)
    SELECT d.doc_id AS doc_id, CASE WHEN j.k IS NULL THEN d.text ELSE concat(head, substr(d.text, e + 1)) END AS masked, CAST(coalesce(n, 0) AS BIGINT) AS findings_count
    FROM {source} d LEFT JOIN j ON j.k = d.doc_id"""


def json_sql(names=PII, source="documents") -> str:
    """(path, json) of each text's report."""
    return f"""WITH r AS ({merged_sql(names, source)}),
    j AS (SELECT doc_id, count(*) AS n, list(struct_pack(detector := detector, category := category, confidence := confidence, masked_sample := masked_sample, line := line) ORDER BY pos) AS findings FROM r GROUP BY doc_id)
    SELECT CAST(d.doc_id AS VARCHAR) AS path, CAST(to_json(struct_pack(path := CAST(d.doc_id AS VARCHAR), status := 'processed', findings_count := coalesce(j.n, 0), findings := coalesce(j.findings, []))) AS VARCHAR) AS json
    FROM {source} d LEFT JOIN j ON j.doc_id = d.doc_id"""


def by_type_sql(names=PII, source="documents") -> str:
    return f"""{merged_ctes(names, source)},
    t AS (SELECT detector, count(*) AS n, min(struct_pack(k := k, pos := pos)) AS seen FROM f GROUP BY detector)
    SELECT detector, n, CAST(row_number() OVER (ORDER BY n DESC, seen) AS BIGINT) AS position FROM t"""


def reading_sql(limit: int, binary: str | None) -> str:
    """(path, text, status, reason) of documents as contents with a leading byte; ``binary`` is
    the status of binary ones, none where they are read as well as they can be."""
    size = "strlen(text) + CASE WHEN doc_id % 4 IN (1, 2) THEN 1 ELSE 0 END"
    large = f"{size} > {limit}"
    why = f"CASE WHEN {large} THEN 'I/O error: file exceeds maximum size ({limit} bytes)'"
    if binary:
        why += " WHEN doc_id % 4 = 2 THEN 'Binary file' WHEN doc_id % 4 = 1 THEN 'I/O error: invalid UTF-8'"
    lead = "CASE doc_id % 4 WHEN 1 THEN chr(65533) WHEN 2 THEN chr(0) ELSE '' END"
    return f"""SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN reason IS NULL THEN concat({lead}, text) END AS text,
      CASE WHEN reason IS NULL THEN 'processed' WHEN reason = 'Binary file' THEN '{binary}' ELSE 'error' END AS status, reason
    FROM (SELECT *, {why} END AS reason FROM documents)"""
