"""SQL twins of the catalog's queries, for an engine with RE2 regular expressions, lists and lambdas."""

from __future__ import annotations

from siftwell.config import STATUSES, SUFFIX_WORDS
from siftwell.functions.clean import MARKER, WS
from siftwell.operators import classify as c
from siftwell.operators.tables import EXPECTED_SOURCES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(WS + '+')}, ' ', 'g'))"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def status(x: str) -> str:
    cases = " ".join(f"WHEN {q(''.join(ch for ch in s.lower() if ch.isalpha()))} THEN {q(s)}" for s in STATUSES)
    return f"CASE regexp_replace(lower({x}), '[^a-z]', '', 'g') {cases} END"


def country(x: str) -> str:
    word = "CASE WHEN length(w) <= 3 AND upper(w) = w AND lower(w) <> w THEN w ELSE upper(substring(w, 1, 1)) || lower(substring(w, 2)) END"
    return f"nullif(array_to_string(list_transform(string_split({squeezed(x)}, ' '), lambda w: {word}), ' '), '')"


def date(x: str) -> str:
    v = f"string_split({trimmed(x)}, 'T')[1]"
    iso, us = r"'^(\d{4})-(\d{1,2})-(\d{1,2})$'", r"'^(\d{1,2})/(\d{1,2})/(\d{4})$'"
    g = lambda p, i: f"regexp_extract({v}, {p}, {i})"
    text = lambda p, y, m, d: f"CASE WHEN regexp_matches({v}, {p}) THEN try_cast({g(p, y)} || '-' || lpad({g(p, m)}, 2, '0') || '-' || lpad({g(p, d)}, 2, '0') AS DATE) END"
    return f"CAST(coalesce({text(iso, 1, 2, 3)}, {text(us, 3, 1, 2)}) AS VARCHAR)"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def email(x: str) -> str:
    return f"nullif(lower({trimmed(x)}), '')"


def email_domain(x: str) -> str:
    return f"CASE WHEN contains({x}, '@') THEN substring({x}, strpos({x}, '@') + 1) WHEN {x} IS NOT NULL THEN '' END"


def unaccented(x: str) -> str:
    return f"strip_accents({x})"


def tokens(x: str, keep: str = "a-z0-9-") -> str:
    return f"list_filter(string_split_regex(lower({unaccented(f"coalesce({x}, '')")}), '[^{keep}]+'), lambda t: t <> '')"


def name_parts(first: str, last: str, full: str, keep: str) -> str:
    f, la, w = (f"coalesce({trimmed(x)}, '')" for x in (first, last, full))
    words = f"string_split({squeezed(w)}, ' ')"
    split = f"({f} = '' AND {la} = '' AND {w} <> '')"
    display = squeezed(f"CASE WHEN {w} <> '' THEN {w} ELSE {f} || ' ' || {la} END")
    parts = {
        "first_name": f"nullif(CASE WHEN {split} THEN CASE WHEN len({words}) > 1 THEN {words}[1] ELSE '' END ELSE {f} END, '') AS first_name",
        "last_name": f"nullif(CASE WHEN {split} THEN {words}[-1] ELSE {la} END, '') AS last_name",
        "display_name": f"nullif({display}, '') AS display_name",
        "name_key": f"array_to_string({tokens(display)}, '') AS name_key",
        "tokens": f"array_to_string({tokens(display)}, ' ') AS tokens",
    }
    return ", ".join(parts[k] for k in keep.split())


def core(x: str) -> str:
    t = tokens(x, "a-z0-9")
    weak = "[" + ", ".join(map(q, SUFFIX_WORDS)) + "]"
    last = f"coalesce(list_max(list_transform(range(1, len({t}) + 1), lambda i: CASE WHEN i = 1 OR NOT list_contains({weak}, {t}[i]) THEN i ELSE 0 END)), 0)"
    return f"coalesce(array_to_string({t}[1:{last}], ' '), '')"


def without_marker(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {q(MARKER)}, '', 'g'))"


def cleaned(x: str) -> str:
    tails = "|".join(p.replace(".", r"\.") for p in c.PROGRESS)
    return f"trim(regexp_replace({without_marker(x)}, {q(rf'(?i)(?:\s*(?:{tails}))+\s*$')}, ''))"


def _has(p: str) -> str:
    return f"regexp_matches(t, {q(p)})"


def _after(p: str) -> str:
    return squeezed(f"trim(regexp_extract(t, {q(p)}, 1), ' .,')")


def _details() -> dict[str, str]:
    booth = f"CASE WHEN {_has(c.NO_QR)} THEN 'Booth conversation (no QR scan logged)' WHEN {_has(c.QR)} THEN 'Booth QR Code' ELSE 'Booth conversation' END"
    return {
        "paid_search": f"'Paid Search — Google Ads' || CASE WHEN {_has(c.PAID_PAGE)} THEN ' (' || regexp_extract(t, {q(c.PAID_PAGE)}, 1) || ' page)' ELSE '' END",
        "event_booth" + c.BOOTH: f"{_after(c.BOOTH)} || ' — ' || {booth}",
        "event_booth" + c.BOOTH_DURING: f"{_after(c.BOOTH_DURING)} || ' — ' || {booth}",
        "referral_named": f"'Warm intro from ' || {_after(c.REFERRED)}",
        "linkedin": f"CASE WHEN {_has(c.OUR_POST)} THEN 'Comment on our post' ELSE 'LinkedIn touchpoint' END",
        "organic": f"'Google organic search' || CASE WHEN {_has(c.LANDED)} THEN ' — ' || {_after(c.LANDED)} ELSE '' END",
        "website_form": f"'Website form — ' || {_after(c.FORM)}",
        "manual_sales": f"CASE WHEN {_has(c.COLD)} THEN 'Cold outreach call' ELSE 'Inbound phone call, logged manually' END",
    }


def sources(source: str, key: str, text: str, page: str | None = None, keywords: bool = False) -> str:
    """A query with key, channel, detail, confidence, method, evidence, taxonomy_gap."""
    details, cols = _details(), {k: [] for k in ("channel", "detail", "confidence", "method", "evidence", "taxonomy_gap")}

    def add(test: str, channel: str, detail: str, confidence: float, method: str, evidence: str, gap: str = "NULL") -> None:
        for k, v in zip(cols, (q(channel), detail, str(confidence), q(method), evidence, gap), strict=True):
            cols[k].append(f"WHEN {test} THEN {v}")

    for r in c.RULES:
        detail = r.detail if isinstance(r.detail, str) else None
        text_of = q(detail) if detail is not None else details.get(r.method) or details[r.method + r.evidence]
        add(" AND ".join(_has(w) for w in r.when), r.channel, text_of, r.confidence, f"rules:{r.method}", f"regexp_extract(t, {q(r.evidence)}, 0)", q(r.gap) if r.gap else "NULL")
    if page:
        label = "replace(replace(trim(trim(page), '/'), '-', ' '), '/', ' / ')"
        add("coalesce(trim(trim(page), '/'), '') <> ''", "Website", f"'Website form — ' || {label} || ' page'", 0.8, "rules:page_url_fallback", "page")
    if keywords:
        for channel, words in c.KEYWORDS:
            add(f"t <> '' AND regexp_matches(lower(t), {q('|'.join(words))})", channel, "''", 0.4, "llm:heuristic", "'Offline keyword match (no model available).'")
        add("t <> ''", "Other", "''", 0.2, "llm:heuristic", "'Offline heuristic found no channel signal in the text.'")
    last = {"channel": "'Other'", "detail": "''", "confidence": "0.2", "method": "'fallback:unclassified'", "evidence": "substring(t, 1, 160)", "taxonomy_gap": "NULL"}
    body = ", ".join(f"CAST(CASE {' '.join(v)} ELSE {last[k]} END AS {'DOUBLE' if k == 'confidence' else 'VARCHAR'}) AS {k}" for k, v in cols.items())
    return f"SELECT {key}, {body} FROM (SELECT *, {cleaned(text)} AS t{f', {page} AS page' if page else ''} FROM {source})"


ONCE = "(SELECT DISTINCT ON (submission_id) * FROM form_submissions)"

BLOCKS = """
  SELECT id, kind, value FROM (SELECT id, unnest([
    {'kind': 'phone', 'value': CASE WHEN length(phone_digits) >= 7 THEN phone_digits END},
    {'kind': 'phone9', 'value': CASE WHEN length(phone_key) >= 9 THEN phone_key END},
    {'kind': 'email', 'value': nullif(email, '')}, {'kind': 'domain', 'value': nullif(domain_root, '')},
    {'kind': 'initial_surname', 'value': CASE WHEN len(name_tokens) >= 1 THEN substring(name_tokens[1], 1, 1) || '|' || name_tokens[-1] END}], recursive := true)
  FROM %s) WHERE value IS NOT NULL"""

PAIRS = "SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM match_pairs WHERE a <> b"


def winkler(x: str, y: str) -> str:
    same = " + ".join(f"CASE WHEN length({x}) >= {i} AND length({y}) >= {i} AND left({x}, {i}) = left({y}, {i}) THEN 1 ELSE 0 END" for i in range(1, 5))
    return f"CASE WHEN {x} = {y} THEN 1.0 WHEN {x} = '' OR {y} = '' OR jaro_similarity({x}, {y}) = 0 THEN 0.0 ELSE jaro_similarity({x}, {y}) + ({same}) * 0.1 * (1 - jaro_similarity({x}, {y})) END"


def squash(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]', '', 'g')"


def local_fit(p: str, r: str) -> str:
    f, la, loc = squash(f"{r}.first_name"), squash(f"{r}.last_name"), squash(f"{p}.email_local")
    i, j = f"substring({f}, 1, 1)", f"substring({la}, 1, 1)"
    return f"CASE WHEN ({f} <> '' AND {loc} = {f}) OR ({la} <> '' AND {loc} = {la}) OR ({f} <> '' AND {la} <> '' AND {loc} IN ({f} || {la}, {la} || {f}, {i} || {la}, {f} || {j}, {la} || {i}, {i} || {j})) THEN 0.5 ELSE 0.0 END"


def features(pairs: str, corpus: str | None = None, left: str = "leads", right: str = "leads") -> str:
    eq = lambda col: f"(coalesce(x.{col}, '') <> '' AND coalesce(x.{col}, '') = coalesce(y.{col}, ''))"
    loose = lambda col, s: f"lower(trim(coalesce({s}.{col}, '')))"
    num = lambda t: f"CASE WHEN {t} THEN 1.0 ELSE 0.0 END"
    weak = "[" + ", ".join(map(q, SUFFIX_WORDS)) + "]"
    ta, tb = tokens("x.company_name", "a-z0-9"), tokens("y.company_name", "a-z0-9")
    one = "coalesce(wm[t], 1.0)" if corpus else f"CASE WHEN list_contains({weak}, t) THEN 0.15 ELSE 1.0 END"
    total = lambda s: f"coalesce(list_sum(list_transform({s}, lambda t: {one})), 0)"
    sim = f"CASE WHEN len({ta}) > 0 AND len({tb}) > 0 THEN {total(f'list_intersect({ta}, {tb})')} / {total(f'list_distinct(list_concat({ta}, {tb}))')} ELSE 0.0 END"
    fit = "list_zip(x.name_tokens, y.name_tokens)"
    bad = "NOT (z[1] = z[2] OR (length(z[1]) = 1 AND starts_with(z[2], z[1])) OR (length(z[2]) = 1 AND starts_with(z[1], z[2])))"
    compat = f"coalesce(len(x.name_tokens) > 0 AND len(x.name_tokens) = len(y.name_tokens) AND len(list_filter({fit}, lambda z: {bad})) = 0, false)"
    suffix = f"(NOT {eq('phone_digits')} AND {eq('phone_key')})"
    base = f"""SELECT a, b, {num(eq('phone_digits'))} AS phone_exact, {num(suffix)} AS phone_suffix,
      {num(f"coalesce(x.phone_key, '') <> '' AND coalesce(y.phone_key, '') <> '' AND x.phone_key <> y.phone_key AND NOT {eq('phone_digits')}")} AS phone_conflict,
      {num(eq('email'))} AS email_exact, {num(eq('email_domain'))} AS domain_exact, {num(eq('domain_root'))} AS domain_root,
      {winkler("coalesce(x.name_key, '')", "coalesce(y.name_key, '')")} AS name_sim, {num(compat)} AS name_initial_compat,
      {local_fit('x', 'y')} + {local_fit('y', 'x')} AS local_consistent, {sim} AS company_sim,
      {num(f"{loose('country', 'x')} <> '' AND {loose('country', 'x')} = {loose('country', 'y')}")} AS country_match,
      {num(f"{loose('country', 'x')} <> '' AND {loose('country', 'y')} <> '' AND {loose('country', 'x')} <> {loose('country', 'y')}")} AS country_conflict,
      {num(f"{loose('job_title', 'x')} <> '' AND {loose('job_title', 'x')} = {loose('job_title', 'y')}")} AS title_match
      FROM ({pairs}) JOIN {left} x ON x.id = a JOIN {right} y ON y.id = b{f' CROSS JOIN ({corpus})' if corpus else ''}"""
    full = f"SELECT *, CASE WHEN name_sim >= 0.97 AND (domain_root > 0 OR company_sim >= 0.9) THEN 1.0 ELSE 0.0 END AS same_name_same_company FROM ({base})"
    z = "-6.0 + 5.0 * phone_exact + 3.5 * phone_suffix - 1.8 * phone_conflict + 5.0 * email_exact + 1.2 * domain_exact + 1.2 * domain_root + 7.0 * (name_sim - 0.72) + 1.5 * name_initial_compat + 2.2 * local_consistent + 1.5 * (company_sim - 0.35) + 0.8 * country_match - 0.8 * country_conflict + 0.4 * title_match + 1.2 * same_name_same_company"
    return f"SELECT *, 1 / (1 + exp(-greatest(-30, least(30, {z})))) AS score FROM ({full})"


REASONS = """list_filter([
  CASE WHEN email_exact > 0 THEN 'identical email address' END,
  CASE WHEN phone_exact > 0 THEN 'identical phone number' WHEN phone_suffix > 0 THEN 'same phone number in a different format' END,
  CASE WHEN name_sim >= 0.97 THEN 'identical name' WHEN name_initial_compat > 0 THEN 'name differs only by an abbreviated first name' WHEN name_sim >= 0.85 THEN 'very similar name' END,
  CASE WHEN local_consistent >= 1 THEN 'both email localparts spell out the same person' WHEN local_consistent > 0 THEN 'one email localpart matches the other record''s name' END,
  CASE WHEN domain_exact > 0 THEN 'same company email domain' WHEN domain_root > 0 THEN 'same company domain root, different TLD' END,
  CASE WHEN company_sim >= 0.6 THEN 'company names share their distinctive tokens' END,
  CASE WHEN same_name_same_company > 0 AND email_exact = 0 AND phone_exact = 0 THEN 'AMBIGUOUS: identical name at the same employer, but no shared phone or email - could equally be two colleagues' END,
  CASE WHEN phone_conflict > 0 THEN 'CONFLICT: different phone numbers' END,
  CASE WHEN country_conflict > 0 THEN 'CONFLICT: different countries' END], lambda r: r IS NOT NULL)"""
FEATURES = "phone_exact phone_suffix phone_conflict email_exact domain_exact domain_root name_sim name_initial_compat local_consistent company_sim country_match country_conflict title_match same_name_same_company".split()

COMPONENTS = """WITH RECURSIVE e AS (SELECT a v, b u FROM (%s) UNION SELECT b, a FROM (%s)), r AS (SELECT v, v u FROM e UNION SELECT r.v, e.u FROM r JOIN e ON r.u = e.v),
  c AS (SELECT v AS id, min(u) AS root FROM r GROUP BY v)"""


def components(links: str) -> str:
    return COMPONENTS % (links, links)


def gram_vectors(text: str) -> str:
    """CTEs g (id, gram, tf), v (id, gram, df, w over the whole norm, usable)."""
    padded = f"' ' || trim(regexp_replace(lower(coalesce({text}, '')), '\\s+', ' ', 'g')) || ' '"
    return f"""d AS (SELECT id, {padded} AS p FROM leads),
      g AS (SELECT id, gram, count(*) AS tf FROM (SELECT id, unnest(list_transform(range(1, length(p) - 1), lambda i: substring(p, i, 3))) AS gram FROM d WHERE length(p) > 2) GROUP BY ALL),
      f AS (SELECT gram, count(*) AS df FROM g GROUP BY gram), n AS (SELECT count(*) AS n FROM d),
      x AS (SELECT g.id, g.gram, f.df, n.n, (1 + ln(tf)) * (ln((n.n + 1) / (f.df + 1)) + 1) AS x FROM g JOIN f USING (gram) CROSS JOIN n),
      v AS (SELECT id, gram, df, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w, df <= greatest(1, floor(n * 0.25)) AS usable FROM x)"""


INDEX_TEXT = "concat_ws(' ', nullif(trim(coalesce(display_name, '')), ''), coalesce(nullif(trim(coalesce(company_core, '')), ''), nullif(trim(coalesce(company_name, '')), '')), nullif(trim(coalesce(email_local, '')), ''), nullif(trim(coalesce(domain_root, '')), ''))"


def sure(left: str, right: str) -> str:
    """(a, b) of records that share a key other than the domain, or within a domain a word, both initials, a mailbox that the other's name spells, or a phone."""
    lines = lambda s: f"list_filter([{s}.phone_digits, {s}.phone_key], lambda t: coalesce(t, '') <> '')"
    initials = lambda s: f"left({s}.name_tokens[1], 1) || left({s}.name_tokens[-1], 1)"
    near = f"""coalesce(len(list_intersect(x.name_tokens, y.name_tokens)) > 0, false) OR coalesce(len(x.name_tokens) > 0 AND len(y.name_tokens) > 0 AND {initials('x')} = {initials('y')}, false)
      OR {local_fit('x', 'y')} > 0 OR {local_fit('y', 'x')} > 0 OR len(list_intersect({lines('x')}, {lines('y')})) > 0"""
    return f"""SELECT x.id AS a, y.id AS b FROM ({BLOCKS % left}) x JOIN ({BLOCKS % right}) y USING (kind, value) WHERE kind <> 'domain'
      UNION SELECT x.id, y.id FROM {left} x JOIN {right} y ON x.domain_root = y.domain_root WHERE x.domain_root <> '' AND ({near})"""


def oracle_sql() -> dict[str, str]:
    classified = sources("leads", "id", "notes")
    with_source = f"SELECT l.*, s.channel AS source_channel, s.method AS source_method, s.taxonomy_gap AS source_taxonomy_gap FROM leads l JOIN ({classified}) s USING (id)"
    dims = "status owner country origin source_channel source_taxonomy_gap".split()
    counted = " UNION ALL ".join(f"SELECT '{x}' AS dimension, coalesce({x}, '(unknown)') AS key, count(*) AS n FROM s {'WHERE source_taxonomy_gap IS NOT NULL' if x.endswith('gap') else ''} GROUP BY 2" for x in dims)
    scored = features(PAIRS)
    expected = "CASE source_channel " + " ".join(f"WHEN {q(k)} THEN [{', '.join(map(q, v))}]" for k, v in EXPECTED_SOURCES.items()) + " END"
    best = "SELECT least(a, b) AS a, greatest(a, b) AS b, max(score) AS score, bool_or(verdict = 'same') AS same FROM match_pairs WHERE a <> b GROUP BY 1, 2"
    profiled = "first_name full_name job_title company_name email phone_raw country status_raw owner_raw created_at notes lead_score".split()
    address = email("email")
    forms = f"SELECT submission_id, {name_parts('NULL', 'NULL', 'name', 'display_name first_name last_name name_key')}, {tokens(squeezed(trimmed('name')))} AS name_tokens, {address} AS email, nullif(string_split({email_domain(address)}, '.')[1], '') AS domain_root, nullif({digits('phone')}, '') AS phone_digits, nullif(right({digits('phone')}, 9), '') AS phone_key, {country('country')} AS country, {date('submitted_at')} AS created_at FROM {ONCE}"
    weights = f"""t AS (SELECT id, list_distinct({tokens('company_name', 'a-z0-9')}) AS t FROM leads WHERE company_name IS NOT NULL), k AS (SELECT unnest(t) AS token FROM t), df AS (SELECT token, count(*) AS df FROM k GROUP BY token),
      idf AS (SELECT token, ln((SELECT count(*) FROM t WHERE len(t) > 0) / df) AS idf FROM df)"""
    weight = "CASE WHEN (SELECT max(idf) FROM idf) > 0 THEN 0.1 + 0.9 * idf / (SELECT max(idf) FROM idf) ELSE 1.0 END"
    band = "score >= 0.4 AND score < 0.9"
    verdict = f"CASE WHEN {band} THEN CASE WHEN phone_exact > 0 OR email_exact > 0 THEN 'same' WHEN name_sim < 0.8 THEN 'different' ELSE 'unsure' END END"
    given = lambda p, n: f"CASE WHEN len({p}) <= 1 OR len({n}) <= 1 THEN len({p}) <= 1 AND len({n}) <= 1 ELSE {p}[1] = {n}[1] OR (length({p}[1]) = 1 AND starts_with({n}[1], {p}[1])) OR (length({n}[1]) = 1 AND starts_with({p}[1], {n}[1])) END"
    block_pairs = f"WITH k AS ({BLOCKS % 'leads'}), s AS (SELECT kind, value FROM k GROUP BY ALL HAVING count(*) BETWEEN 2 AND 80), o AS (SELECT k.* FROM k JOIN s USING (kind, value)) SELECT x.id AS a, y.id AS b, array_to_string(list_sort(list(DISTINCT x.kind)), ',') AS blocked_by FROM o x JOIN o y USING (kind, value) WHERE x.id < y.id GROUP BY x.id, y.id"
    corpus = f"WITH {weights} SELECT map(list(token), list({weight})) AS wm FROM idf"
    neighbours = f"WITH {gram_vectors(INDEX_TEXT)}, s AS (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS score FROM v x JOIN v y USING (gram) WHERE x.usable AND y.usable AND x.id <> y.id GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, b) AS place FROM s) SELECT a, b, round(score, 6) AS score FROM r WHERE place <= 8 AND score >= 0.35"
    judged = f"CASE {verdict} WHEN 'same' THEN greatest(score, 0.9 + 0.1 * 0.95) WHEN 'different' THEN least(score, 0.4 * 0.2) ELSE score END"
    resolved = f"""WITH RECURSIVE cand AS MATERIALIZED (SELECT a, b FROM ({block_pairs}) UNION SELECT least(a, b), greatest(a, b) FROM ({neighbours})),
      s AS MATERIALIZED (SELECT a, b, score AS score_before, {judged} AS score FROM ({features('SELECT a, b FROM cand', corpus)}) WHERE score >= 0.4),
      e AS (SELECT a v, b u FROM s WHERE score >= 0.7 UNION SELECT b, a FROM s WHERE score >= 0.7), r AS (SELECT v, v u FROM e UNION SELECT r.v, e.u FROM r JOIN e ON r.u = e.v), c AS (SELECT v AS id, min(u) AS root FROM r GROUP BY v),
      m AS (SELECT root, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS lead_ids, count(*) AS size FROM c GROUP BY root), p AS (SELECT root, round(min(score), 4) AS confidence FROM s JOIN c ON c.id = a WHERE score >= 0.7 GROUP BY root)"""
    submitted = f"""SELECT submission_id AS id, {name_parts('NULL', 'NULL', 'name', 'display_name first_name last_name name_key')}, {tokens(squeezed(trimmed('name')))} AS name_tokens, {address} AS email, string_split({address}, '@')[1] AS email_local,
      nullif({email_domain(address)}, '') AS email_domain, nullif(string_split({email_domain(address)}, '.')[1], '') AS domain_root, nullif({trimmed('phone')}, '') AS phone_raw, nullif({digits('phone')}, '') AS phone_digits, nullif(right({digits('phone')}, 9), '') AS phone_key,
      {country('country')} AS country, nullif({trimmed('company')}, '') AS company_name, NULL AS job_title FROM {ONCE}"""
    decided = f"""WITH RECURSIVE sub AS MATERIALIZED ({submitted}), ok AS MATERIALIZED (SELECT * FROM sub WHERE email IS NOT NULL OR phone_raw IS NOT NULL),
      h AS (SELECT DISTINCT x.id AS a, y.id AS b FROM ({BLOCKS % 'ok'}) x JOIN ({BLOCKS % 'leads'}) y USING (kind, value)),
      hits AS MATERIALIZED (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b) AS r FROM h) WHERE r <= 200 UNION {sure('ok', 'leads')}),
      s AS MATERIALIZED (SELECT * FROM (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, b) AS place FROM ({features('SELECT a, b FROM hits', corpus, 'ok')})) WHERE place <= 3),
      best AS (SELECT a, max(CASE WHEN place = 1 THEN b END) AS lead_id, max(CASE WHEN place = 1 THEN score END) AS score, count(*) FILTER (score >= 0.4) AS near FROM s GROUP BY a),
      dec AS MATERIALIZED (SELECT sub.id AS submission_id, CASE WHEN ok.id IS NULL THEN 'rejected' WHEN coalesce(score, 0) >= 0.9 THEN 'updated' ELSE 'created' END AS action, lead_id, coalesce(score, 0) AS score, coalesce(near, 0) AS near FROM sub LEFT JOIN ok USING (id) LEFT JOIN best ON a = sub.id)"""
    review = "action = 'created' AND score >= 0.4"
    fresh = f"""fresh AS MATERIALIZED (SELECT ok.* FROM ok JOIN dec ON dec.submission_id = ok.id WHERE action = 'created'),
      close AS MATERIALIZED (SELECT a, b FROM ({features(f"SELECT a, b FROM ({sure('fresh', 'fresh')}) WHERE a < b", None, 'fresh', 'fresh')}) WHERE score >= 0.9),
      e AS (SELECT a v, b u FROM close UNION SELECT b, a FROM close), r AS (SELECT v, v u FROM e UNION SELECT r.v, e.u FROM r JOIN e ON r.u = e.v),
      made AS (SELECT (SELECT count(*) FROM fresh) - (SELECT count(DISTINCT v) - count(DISTINCT root) FROM (SELECT v, min(u) AS root FROM r GROUP BY v)) AS n),
      every AS (SELECT origin, count(*) AS n FROM leads GROUP BY origin UNION ALL SELECT 'form', n FROM made WHERE n > 0)"""
    same_links = "SELECT a, b FROM match_pairs WHERE a <> b AND verdict = 'same'"
    hash_of = "SELECT root, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS m FROM {} GROUP BY root"
    return {
        "lead_dashboard": f"WITH s AS ({with_source}), c AS ({counted}), r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, key) AS place FROM c) SELECT dimension, key, n, CAST(place AS INTEGER) AS place FROM r WHERE dimension <> 'country' OR place <= 10",
        "lead_filter_page": "SELECT id, display_name, status, owner FROM leads WHERE status = 'Qualified' AND lower(owner) = 'karin dolstad' ORDER BY id LIMIT 50 OFFSET 5",
        "lead_filter_total": "SELECT count(*) AS total FROM leads WHERE lower(country) = 'germany' AND (contains(lower(coalesce(display_name, '')), 'an') OR contains(lower(coalesce(company_name, '')), 'an') OR contains(lower(coalesce(email, '')), 'an'))",
        "lead_search": "SELECT id, display_name, company_name, email FROM leads WHERE contains(lower(coalesce(display_name, '')), 'ven') OR contains(lower(coalesce(company_name, '')), 'ven') OR contains(lower(coalesce(email, '')), 'ven')",
        "lead_export": "SELECT id, display_name, job_title, company_name, email, phone_raw, country, status, lifecycle_stage, owner, created_at, updated_at, lead_score, origin FROM leads ORDER BY id",
        "lead_get": "SELECT id, display_name, email, status FROM leads WHERE id = (SELECT max(id) FROM leads)",
        "norm_status": f"SELECT id, {status('status_raw')} AS canonical, status IS NOT DISTINCT FROM {status('status_raw')} AS as_stored FROM leads",
        "norm_owner": f"SELECT id, nullif({squeezed('owner_raw')}, '') AS owner, owner IS NOT DISTINCT FROM nullif({squeezed('owner_raw')}, '') AS as_stored FROM leads",
        "norm_country": f"SELECT id, {country('country')} AS country FROM leads",
        "norm_dates": f"SELECT id, {date('created_at')} AS created, {date('updated_at')} AS updated FROM leads",
        "norm_phone_email": f"SELECT id, {digits('phone_raw')} AS digits, right({digits('phone_raw')}, 9) AS phone_key, {address} AS email, string_split({address}, '@')[1] AS email_local, {email_domain(address)} AS email_domain, string_split({email_domain(address)}, '.')[1] AS domain_root, coalesce(CASE WHEN email_local = regexp_replace(email_local, '[^a-z0-9]', '', 'g') THEN email_local ELSE email_local || ',' || regexp_replace(email_local, '[^a-z0-9]', '', 'g') END, '') AS variants FROM (SELECT id, phone_raw, email, lower(email_local) AS email_local FROM leads)",
        "norm_names": f"SELECT id, {name_parts('first_name', 'last_name', 'full_name', 'first_name last_name display_name name_key tokens')} FROM leads",
        "company_core": f"SELECT id, {core('company_name')} AS company_core, array_to_string({tokens('company_name', 'a-z0-9')}, ' ') AS tokens FROM leads",
        "note_markers": f"SELECT id, regexp_matches(coalesce(notes, ''), {q(MARKER)}) AS marked, {without_marker('notes')} AS note FROM leads",
        "whole_numbers": r"SELECT id, CASE WHEN regexp_matches(trim(phone_raw), '^[+-]?\d+$') THEN try_cast(trim(phone_raw) AS INTEGER) END AS number FROM leads",
        "json_rows": "SELECT id, CAST(coalesce(len(name_tokens), -1) AS INTEGER) AS n_tokens FROM leads",
        "classify_notes": classified,
        "classify_forms": sources(ONCE, "submission_id", "message", "page_url", True),
        "channel_histogram": f"SELECT source_channel, source_method, count(*) AS n FROM ({with_source}) GROUP BY ALL",
        "channel_expectation": f"SELECT source_channel, count(*) AS n, count(*) FILTER (list_contains({expected}, trim(original_source))) AS agree FROM ({with_source}) WHERE trim(coalesce(original_source, '')) <> '' GROUP BY 1",
        "block_pairs": block_pairs,
        "block_stats": f"SELECT kind, count(*) AS blocks, count(*) FILTER (n BETWEEN 2 AND 80) AS usable, count(*) FILTER (n > 80) AS oversized FROM (SELECT kind, value, count(*) AS n FROM ({BLOCKS % 'leads'}) GROUP BY ALL) GROUP BY kind",
        "company_weights": f"WITH {weights} SELECT token, round({weight}, 6) AS weight FROM idf",
        "char_grams": f"WITH {gram_vectors('display_name')} SELECT gram, CAST(sum(tf) AS BIGINT) AS n, count(*) AS df FROM g GROUP BY gram",
        "ngram_neighbours": neighbours,
        "pair_scores_corpus": f"SELECT a, b, CAST(round(company_sim, 6) AS DOUBLE) AS company_sim, round(score, 6) AS score FROM ({features(PAIRS, corpus)})",
        "resolve_groups": f"{resolved} SELECT 'dup-' || root AS group_id, lead_ids, size, confidence FROM m JOIN p USING (root)",
        "resolve_stats": f"""{resolved}, n AS (SELECT count(*) AS records, count(*) * (count(*) - 1) / 2 AS whole FROM leads), k AS (SELECT count(*) AS candidate_pairs FROM cand),
          o AS (SELECT count(*) AS oversized_blocks_skipped FROM (SELECT kind, value FROM ({BLOCKS % 'leads'}) GROUP BY ALL HAVING count(*) > 80))
          SELECT records, candidate_pairs, oversized_blocks_skipped, (SELECT count(*) FROM s) AS pairs_above_review_floor, (SELECT count(*) FROM s WHERE score_before >= 0.4 AND score_before < 0.9) AS adjudicated_pairs, (SELECT count(*) FROM m) AS groups, CAST((SELECT coalesce(sum(size), 0) FROM m) AS BIGINT) AS records_in_groups,
          CAST(whole AS BIGINT) AS full_pairwise_comparisons, CAST(CASE WHEN whole > 0 THEN round(1 - candidate_pairs / whole, 4) ELSE 0.0 END AS DOUBLE) AS reduction_ratio, CAST(0.7 AS DOUBLE) AS min_confidence FROM n CROSS JOIN k CROSS JOIN o""",
        "name_similarity": f"SELECT a, b, round(CASE WHEN p = r THEN 1.0 WHEN p = '' OR r = '' THEN 0.0 ELSE jaro_similarity(p, r) END, 6) AS jaro, round({winkler('p', 'r')}, 6) AS jaro_winkler FROM (SELECT a, b, coalesce(x.name_key, '') AS p, coalesce(y.name_key, '') AS r FROM ({PAIRS}) JOIN leads x ON x.id = a JOIN leads y ON y.id = b)",
        "pair_scores": f"SELECT a, b, {', '.join(f'CAST(round({f}, 6) AS DOUBLE) AS {f}' for f in FEATURES)}, round(score, 6) AS score, array_to_string({REASONS}, '; ') AS reasons FROM ({scored})",
        "band_adjudicated": f"SELECT a, b, round(score, 6) AS score_before, round(CASE {verdict} WHEN 'same' THEN greatest(score, 0.9 + 0.1 * 0.95) WHEN 'different' THEN least(score, 0.4 * 0.2) ELSE score END, 6) AS score, {verdict} AS verdict FROM ({scored})",
        "dup_components": f"{components('SELECT a, b FROM match_pairs WHERE score >= 0.7 AND a <> b')} SELECT id, root FROM c",
        "dup_groups": f"{components(f'SELECT a, b FROM ({best}) WHERE score >= 0.7')}, m AS (SELECT root, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS lead_ids, count(*) AS size FROM c GROUP BY root), p AS (SELECT root, round(min(score), 4) AS confidence, round(max(score), 4) AS max_pair_confidence, CAST(count(*) AS INTEGER) AS n_pairs FROM ({best}) JOIN c ON c.id = a WHERE score >= 0.7 GROUP BY root) SELECT 'dup-' || root AS group_id, lead_ids, size, confidence, max_pair_confidence, n_pairs FROM m JOIN p USING (root)",
        "submission_probe": f"WITH f AS (SELECT submission_id AS id, * EXCLUDE (submission_id) FROM ({forms})), h AS (SELECT x.id AS submission_id, y.id, array_to_string(list_sort(list(DISTINCT x.kind)), ',') AS kinds FROM ({BLOCKS % 'f'}) x JOIN ({BLOCKS % 'leads'}) y USING (kind, value) GROUP BY x.id, y.id) SELECT submission_id, id, kinds FROM (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY id) AS r FROM h) WHERE r <= 200",
        "ingest_actions": f"{decided} SELECT submission_id, action, CASE WHEN action = 'updated' THEN lead_id END AS lead_id, CASE WHEN action <> 'rejected' THEN CAST(round(score, 4) AS DOUBLE) END AS confidence, {review} AS needs_review, CAST(CASE WHEN {review} THEN near ELSE 0 END AS INTEGER) AS n_possible FROM dec",
        "ingest_summary": f"{decided} SELECT count(*) AS processed, count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'rejected') AS rejected, count(*) FILTER ({review}) AS needs_review FROM dec",
        "ingest_snapshot": f"{decided}, {fresh} SELECT origin, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) AS n_ids FROM every GROUP BY origin",
        "patch_apply": "SELECT id, CASE WHEN country IS NULL THEN 'Closed Won' ELSE status END AS status, CASE WHEN country IS NULL THEN 'closed-won' ELSE status_raw END AS status_raw, CASE WHEN country IS NULL THEN 'Karin Dolstad' ELSE owner END AS owner, CASE WHEN country IS NULL THEN '2026-01-31' ELSE updated_at END AS updated_at FROM leads",
        "enrich_merge": "SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN coalesce({x}, '') = '' THEN '{x}' END" for x in "job_title company_name company_core email email_local email_domain domain_root phone_raw phone_digits phone_key country full_name".split()) + ", CASE WHEN NOT contains(coalesce(notes, ''), 'note ' || id) THEN 'notes' END], lambda x: x IS NOT NULL), ',') AS filled, CASE WHEN coalesce(job_title, '') = '' THEN 'Buyer' ELSE job_title END AS job_title, CASE WHEN coalesce(company_name, '') = '' THEN 'Acme' ELSE company_name END AS company_name, CASE WHEN coalesce(email, '') = '' THEN 'x@acme.test' ELSE email END AS email, CASE WHEN coalesce(country, '') = '' THEN 'Chile' ELSE country END AS country, CASE WHEN NOT contains(coalesce(notes, ''), 'note ' || id) THEN trim(trim(coalesce(notes, '')) || chr(10) || 'note ' || id) ELSE notes END AS notes FROM leads",
        "id_allocation": "SELECT submission_id, (SELECT coalesce(max(id), 100000000) FROM leads) + row_number() OVER (ORDER BY submission_id) AS id FROM (SELECT DISTINCT submission_id FROM form_submissions)",
        "label_pairs": f"SELECT x.id AS a, y.id AS b FROM leads x JOIN leads y ON y.id BETWEEN x.id + 1 AND x.id + 3 AND x.domain_root = y.domain_root AND x.domain_root <> '' WHERE len(x.name_tokens) > 0 AND len(y.name_tokens) > 0 AND ({given('x.name_tokens', 'y.name_tokens')}) AND {winkler('x.name_tokens[-1]', 'y.name_tokens[-1]')} >= 0.92",
        "prf_sweep": f"WITH m AS ({best}), c AS (SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (score >= t AND coalesce(same, false)) AS tp, count(*) FILTER (score >= t AND NOT coalesce(same, false)) AS fp, count(*) FILTER (score < t AND coalesce(same, false)) AS fn FROM m CROSS JOIN (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99]) AS t) GROUP BY t), p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM c) SELECT threshold, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1 FROM p",
        "pair_sets": f"WITH f AS (SELECT a, b FROM ({block_pairs}) SEMI JOIN ({PAIRS}) USING (a, b)), t AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM match_pairs WHERE a <> b AND verdict = 'same') SELECT a, b, 'recovered' AS outcome FROM f SEMI JOIN t USING (a, b) UNION ALL SELECT a, b, 'missed' FROM t ANTI JOIN f USING (a, b) UNION ALL SELECT a, b, 'extra' FROM f ANTI JOIN t USING (a, b)",
        "cluster_exact": f"WITH t AS (SELECT * FROM ({hash_of.format('(' + components(same_links) + ' SELECT * FROM c)')})), f AS (SELECT * FROM ({hash_of.format('(' + components('SELECT a, b FROM match_pairs WHERE a <> b AND score >= 0.9') + ' SELECT * FROM c)')})) SELECT (SELECT count(*) FROM t) AS true_groups, (SELECT count(*) FROM f) AS found_groups, (SELECT count(*) FROM f SEMI JOIN t USING (root, m)) AS exact",
        "profile_fill": " UNION ALL ".join(f"SELECT '{x}' AS column, count(*) FILTER (trim(coalesce(CAST({x} AS VARCHAR), '')) <> '') AS filled, round(100 * count(*) FILTER (trim(coalesce(CAST({x} AS VARCHAR), '')) <> '') / count(*), 1) AS fill_pct, count(DISTINCT CASE WHEN trim(coalesce(CAST({x} AS VARCHAR), '')) <> '' THEN {x} END) AS distinct_values, count(*) FILTER (trim(coalesce(CAST({x} AS VARCHAR), '')) <> '') = 0 AS always_empty FROM leads" for x in profiled),
        "profile_slash": r"WITH v AS (SELECT trim(created_at) AS v FROM leads UNION ALL SELECT trim(updated_at) FROM leads), s AS (SELECT v FROM v WHERE regexp_matches(v, '^\d{1,2}/\d{1,2}/\d{4}$')) SELECT count(*) AS slash_dates, max(CAST(string_split(v, '/')[1] AS INTEGER)) AS max_first, max(CAST(string_split(v, '/')[2] AS INTEGER)) AS max_second FROM s",
        "csv_normalise": f"SELECT id, {name_parts('first_name', 'last_name', 'full_name', 'display_name name_key')}, {address} AS email, nullif(string_split({email_domain(address)}, '.')[1], '') AS domain_root, nullif(right({digits('phone_raw')}, 9), '') AS phone_key, {country('country')} AS country, {status('status_raw')} AS status, nullif({squeezed('owner_raw')}, '') AS owner, {date('created_at')} AS created_at, lead_score, s.channel AS source_channel, s.method AS source_method FROM leads l JOIN ({classified}) s USING (id)",
        "form_normalise": f"SELECT submission_id, display_name, first_name, last_name, name_key, f.email, f.domain_root, f.phone_key, f.country, f.created_at, s.channel AS source_channel FROM ({forms}) f JOIN ({sources(ONCE, 'submission_id', 'message', 'page_url')}) s USING (submission_id)",
    }
