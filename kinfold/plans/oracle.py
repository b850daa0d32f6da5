"""DuckDB SQL for the registered queries, put together from common table expressions."""

from __future__ import annotations

from kinfold.functions import tables


def quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def aliases(x: str) -> str:
    return rf"regexp_replace({x}, '{tables.ALIAS}', ' ', 'g')"


def acronyms(x: str) -> str:
    """Longest first, up to six letters; RE2 has no callback."""
    for n in range(6, 1, -1):
        x = rf"regexp_replace({x}, '\b" + r"([a-z])\." * n + r"([^a-z0-9_]|$)', '" + "".join(rf"\{i}" for i in range(1, n + 2)) + "', 'g')"
    return x


def ampersand(x: str) -> str:
    return f"replace({x}, '&', ' and ')"


def joined(x: str) -> str:
    for _ in range(2):
        x = rf"regexp_replace({x}, '([a-z])[-/]([a-z])', '\1 \2', 'g')"
    return x


def punctuation(x: str) -> str:
    return rf"regexp_replace({x}, '[^a-z0-9/\- ]', ' ', 'g')"


def stray(x: str) -> str:
    for _ in range(3):
        x = rf"regexp_replace({x}, '(^|[^0-9])[-/]($|[^0-9])', '\1 \2', 'g')"
    return x


def phrases(x: str) -> str:
    for phrase, short in tables.PHRASES:
        x = rf"regexp_replace({x}, '\b{phrase}\b', '{short}', 'g')"
    return x


def words(x: str) -> str:
    return f"list_filter(list_transform(string_split(trim({x}), ' '), lambda t: trim(t, '-/')), lambda t: t <> '')"


def zeros(t: str) -> str:
    return rf"CASE WHEN regexp_full_match({t}, '[0-9]+') THEN regexp_replace({t}, '^0+([0-9])', '\1') ELSE {t} END"


def leet(t: str) -> str:
    digits, letters = f"length(regexp_replace({t}, '[^0-9]', '', 'g'))", f"length(regexp_replace({t}, '[^a-z]', '', 'g'))"
    return f"CASE WHEN {digits} > 0 AND {letters} >= 3 AND {letters} > {digits} AND NOT regexp_matches({t}, '{tables.ORDINAL}') THEN translate({t}, '{tables.LEET_FROM}', '{tables.LEET_TO}') ELSE {t} END"


def name_words(w: str) -> str:
    core = f"list_filter({w}, lambda t: NOT list_contains({quoted([*tables.LEGAL_WORDS, 'and'])}, t))"
    return f"CASE WHEN len({core}) > 0 THEN {core} ELSE {w} END"


def mapped(table: dict[str, str], t: str) -> str:
    return f"coalesce({quoted(table.values())}[list_position({quoted(table)}, {t})], {t})"


def address_words(w: str) -> str:
    w = f"list_transform({w}, lambda t: {mapped(tables.ADDRESS_WORDS, 't')})"
    w = f"list_transform({w}, lambda t: {mapped(tables.STATES, 't')})"
    return f"list_filter({w}, lambda t: NOT list_contains({quoted(tables.ADDRESS_FILLER)}, t))"


def split(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def parts(w: str) -> str:
    return f"flatten(list_transform(list_filter({w}, lambda t: NOT regexp_full_match(t, '[0-9]+')), lambda t: list_filter(regexp_extract_all(t, '[0-9]+'), lambda r: length(r) >= 2)))"


def pairs(w: str) -> str:
    return f"list_transform(range(1, len({w})), lambda i: {w}[i] || '_' || {w}[i + 1])"


def jaccard(a: str, b: str) -> str:
    """Of two lists of distinct items."""
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN -1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence: a fold over b of the rows of the usual table."""
    row = "list_reduce(range(1, length({a}) + 1), lambda acc, j: list_append(acc, CASE WHEN substr({a}, j::INTEGER, 1) = substr({b}, i::INTEGER, 1) THEN prev[j] + 1 ELSE greatest(acc[len(acc)], prev[j + 1]) END), [0::BIGINT])".replace("{a}", a).replace("{b}", b)
    start = f"list_transform(range(0, length({a}) + 1), lambda x: 0::BIGINT)"
    return f"list_max(list_reduce(range(1, length({b}) + 1), lambda prev, i: {row}, {start}))"


def base(x: str) -> str:
    """All string steps before words."""
    for f in (aliases, acronyms, ampersand, joined, punctuation, stray, phrases):
        x = f(x)
    return x


# steps are separate expressions so that each is computed once
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "rec": ((), "SELECT doc_id, CASE WHEN doc_id % 10 < 3 THEN 'S1' WHEN doc_id % 2 = 0 THEN 'S2' ELSE 'S3' END AS source, lang AS country, n_chars, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents"),
    "records": (
        ("rec",),
        """SELECT doc_id, source || '_' || doc_id AS entity_id, source, country, array_to_string(w[1:4], ' ') AS first_words,
        array_to_string(w[1:4], ' ') || [' Pvt Ltd', ' L.L.C.', '', ' & Co', ' Inc.'][(doc_id % 5 + 1)::INTEGER] AS business_name,
        CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'No. ' || (n_chars % 997) || ' ' || array_to_string(w[5:16], ' ') || [' Rd', ' Road', ' Nr Opp St'][(doc_id % 3 + 1)::INTEGER] || ', ' || (10000 + n_chars * 37 % 89999) END AS business_address
        FROM rec""",
    ),
    "norm1": (("records",), f"SELECT *, {base('lower(business_name)')} AS n1, {base('lower(business_address)')} AS a1 FROM records"),
    "norm2": (("norm1",), "SELECT *, list_transform(list_transform({n}, lambda t: {z}), lambda t: {l}) AS n2, list_transform(list_transform({a}, lambda t: {z}), lambda t: {l}) AS a2 FROM norm1".format(n=words("n1"), a=words("a1"), z=zeros("t"), l=leet("t"))),
    "norm3": (("norm2",), f"SELECT doc_id, entity_id, source, country, first_words, business_name, business_address, array_to_string({name_words('n2')}, ' ') AS name_n, array_to_string({address_words('a2')}, ' ') AS addr_n FROM norm2"),
    "norm": (("norm3",), f"SELECT *, array_to_string(list_concat([name_n, addr_n], {parts(split('addr_n'))}), ' ') AS block_text FROM norm3"),
    "terms": (("norm",), f"SELECT entity_id, country, source, list_concat(list_concat({split('block_text')}, {pairs(split('name_n'))}), {pairs(split('addr_n'))}) AS terms FROM norm"),
    "addr_terms": (("norm",), f"SELECT entity_id, country, source, doc_id, list_concat(list_concat({split('addr_n')}, {parts(split('addr_n'))}), {pairs(split('addr_n'))}) AS terms FROM norm WHERE addr_n <> ''"),
    "truth": (
        ("records",),
        "SELECT 'S1_' || o.owner AS s1_id, r.entity_id AS cand_id FROM records r JOIN (SELECT country, first_words, min(doc_id) AS owner FROM records WHERE source = 'S1' GROUP BY ALL) o USING (country, first_words) WHERE r.source <> 'S1'",
    ),
}


def search(prefix: str, terms: str, max_df: int = 2000, fallback: bool = True, s1_filter: str = "TRUE") -> dict:
    """CTEs of a TF-IDF search over a table of terms; {prefix}_score has all pairs."""
    p = prefix
    limit = f"(df <= least({max_df}, n)" + (" OR kept = 0)" if fallback else ")")
    return {
        f"{p}_tf": ((terms,), f"SELECT country, entity_id, source, term, count(*) AS tf FROM (SELECT country, entity_id, source, unnest(terms) AS term FROM {terms} WHERE source <> 'S1' OR {s1_filter}) GROUP BY ALL"),
        f"{p}_vocab": (
            (f"{p}_tf", terms),
            f"""SELECT country, term, df, n, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (
            SELECT d.country, d.term, d.df, s.n, sum(CASE WHEN d.df <= least({max_df}, s.n) THEN 1 ELSE 0 END) OVER (PARTITION BY d.country) AS kept
            FROM (SELECT country, term, count(*) AS df FROM {p}_tf WHERE source <> 'S1' GROUP BY ALL) d
            JOIN (SELECT country, count(*) AS n FROM {terms} WHERE source <> 'S1' GROUP BY ALL) s USING (country)) WHERE {limit}""",
        ),
        f"{p}_raw": ((f"{p}_tf", f"{p}_vocab"), f"SELECT country, entity_id, source, term, (1 + ln(tf)) * idf AS raw FROM {p}_tf JOIN {p}_vocab USING (country, term)"),
        f"{p}_w": ((f"{p}_raw",), f"SELECT country, entity_id, source, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY country, entity_id)) AS w FROM {p}_raw"),
        f"{p}_score": ((f"{p}_w",), f"SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, sum(a.w * b.w) AS score FROM {p}_w a JOIN {p}_w b USING (country, term) WHERE a.source = 'S1' AND b.source <> 'S1' GROUP BY ALL"),
    }


def ranked(score: str, k: int = 20, reverse_k: int = 3) -> str:
    return f"""SELECT s1_id, cand_id, score, row_number() OVER (PARTITION BY s1_id ORDER BY round(score, 9) DESC, cand_id) - 1 AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY round(score, 9) DESC, cand_id) AS f, row_number() OVER (PARTITION BY cand_id ORDER BY round(score, 9) DESC, s1_id) AS r FROM {score}) WHERE f <= {k} OR r <= {reverse_k}"""


CTES |= search("m", "terms")
CTES["cand"] = (("m_score",), ranked("m_score"))
CTES |= search("a", "addr_terms", fallback=False, s1_filter="doc_id % 20 = 0")
CTES["addr_cand"] = (("a_score",), "SELECT * FROM (SELECT s1_id, cand_id, score, row_number() OVER (PARTITION BY s1_id ORDER BY round(score, 9) DESC, cand_id) - 1 AS rank FROM a_score) WHERE rank < 20")
CTES["scored"] = (
    ("cand", "norm"),
    "SELECT s1_id, cand_id, rank, round(0.5 * score + 0.5 * greatest(" + jaccard("list_distinct(" + split("a.name_n") + ")", "list_distinct(" + split("b.name_n") + ")") + ", 0.0), 6) AS prob FROM cand JOIN norm a ON a.entity_id = s1_id JOIN norm b ON b.entity_id = cand_id",
)
CTES["assigned"] = (("scored",), "SELECT s1_id, cand_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS n FROM scored WHERE prob >= 0.7) WHERE n = 1")
CTES["assigned02"] = (("scored",), "SELECT s1_id, cand_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS n FROM scored WHERE prob >= 0.02) WHERE n = 1")
CTES["s1"] = (("records",), "SELECT entity_id AS s1_id, doc_id AS pos, country FROM records WHERE source = 'S1'")


def f05(tp: str, predicted: str, true: str) -> str:
    return f"CASE WHEN {true} = 0 AND {predicted} = 0 THEN 1.0 WHEN {tp} = 0 THEN 0.0 ELSE 1.25 * ({tp} / {predicted}::DOUBLE) * ({tp} / {true}::DOUBLE) / (0.25 * ({tp} / {predicted}::DOUBLE) + {tp} / {true}::DOUBLE) END"


CTES["outcomes"] = (
    ("assigned", "truth", "scored"),
    """SELECT e.s1_id, e.cand_id, CASE WHEN t AND p THEN 'tp' WHEN p THEN 'fp' WHEN c.cand_id IS NOT NULL THEN 'fn' ELSE 'miss' END AS outcome, o.owner, (k.cand_id IS NOT NULL) AS taken, c.prob
    FROM (SELECT s1_id, cand_id, bool_or(t) AS t, bool_or(p) AS p FROM (SELECT s1_id, cand_id, TRUE AS t, FALSE AS p FROM truth UNION ALL SELECT s1_id, cand_id, FALSE, TRUE FROM assigned) GROUP BY ALL) e
    LEFT JOIN scored c USING (s1_id, cand_id) LEFT JOIN (SELECT cand_id, min(s1_id) AS owner FROM truth GROUP BY ALL) o ON o.cand_id = e.cand_id LEFT JOIN (SELECT DISTINCT cand_id FROM assigned) k ON k.cand_id = e.cand_id""",
)
CTES["ent"] = (
    ("s1", "assigned", "truth"),
    f"""SELECT s1.s1_id, coalesce(t.n, 0) AS n_true, coalesce(p.n, 0) AS n_pred, coalesce(p.tp, 0) AS tp, {f05('coalesce(p.tp, 0)', 'coalesce(p.n, 0)', 'coalesce(t.n, 0)')} AS score
    FROM s1 LEFT JOIN (SELECT s1_id, count(*) AS n FROM truth GROUP BY ALL) t USING (s1_id)
    LEFT JOIN (SELECT a.s1_id, count(*) AS n, count(t.cand_id) AS tp FROM assigned a LEFT JOIN truth t USING (s1_id, cand_id) GROUP BY ALL) p USING (s1_id)""",
)
CTES["errs"] = (
    ("s1", "outcomes"),
    """SELECT s1.s1_id, s1.country, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn, count(*) FILTER (outcome = 'miss') AS miss, count(*) FILTER (outcome = 'fp' AND owner IS NOT NULL) AS fp_stolen
    FROM s1 LEFT JOIN outcomes USING (s1_id) GROUP BY ALL""",
)
CTES["err_scores"] = (
    ("errs",),
    f"SELECT *, tp + fn + miss AS n_true, {f05('tp', '(tp + fp)', '(tp + fn + miss)')} AS score, {f05('(tp + fn)', '(tp + fn)', '(tp + fn + miss)')} AS ceiling, {f05('tp', 'tp', '(tp + fn + miss)')} AS no_fp, {f05('(tp + fn)', '(tp + fn + fp)', '(tp + fn + miss)')} AS no_fn FROM errs",
)


def token_set(a: str, b: str) -> str:
    """F3 of columns of distinct words i (shared), and sorted rests joined: p, q."""
    return f"""CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 WHEN shared > 0 AND (p = '' OR q = '') THEN 100.0 ELSE greatest(
        100 - 100.0 * (length(p) + length(q) - 2 * {lcs('p', 'q')}) / (2 * sl + 2 * g + length(p) + length(q)),
        CASE WHEN g = 0 THEN 0.0 ELSE 100 - 100.0 * (g + length(p)) / (2 * sl + g + length(p)) END,
        CASE WHEN g = 0 THEN 0.0 ELSE 100 - 100.0 * (g + length(q)) / (2 * sl + g + length(q)) END) END"""


def poisson_binomial(p: str) -> str:
    """Distribution of the number of matches among independent ones: place i holds i - 1 matches."""
    return f"list_reduce({p}, lambda acc, q: list_transform(range(1, len(acc) + 2), lambda i: coalesce(acc[i], 0.0) * (1 - q) + CASE WHEN i > 1 THEN acc[i - 1] * q ELSE 0.0 END), [1.0::DOUBLE])"


def decoded(source: str, keys: str = "s1_id") -> str:
    """Predicted pairs of source (keys, cand_id, prob, p), p being clipped, by exact expected scores."""
    return f"""SELECT {keys}, ids[i] AS cand_id, probs[i] AS prob, i - 1 AS place FROM (
        SELECT {keys}, ids, probs, CASE WHEN round(none, 12) >= list_max(scores) THEN 0 ELSE list_position(scores, list_max(scores)) END AS best FROM (
          SELECT {keys}, ids, probs, list_product(list_transform(ps, lambda q: 1 - q)) AS none, list_transform(range(1, len(ps) + 1), lambda k: round(
            list_sum(list_transform(range(1, k + 2), lambda t: list_sum(list_transform(range(1, len(ps) - k + 2), lambda u: heads[k][t] * tails[k][u] * 1.25 * (t - 1) / (0.25 * (t + u - 2) + k))))), 12)) AS scores FROM (
              SELECT *, list_transform(range(1, len(ps) + 1), lambda k: {poisson_binomial('ps[1:k]')}) AS heads, list_transform(range(1, len(ps) + 1), lambda k: {poisson_binomial('ps[k + 1:len(ps)]')}) AS tails FROM (
                SELECT {keys}, list(p ORDER BY p DESC, cand_id) AS ps, list(cand_id ORDER BY p DESC, cand_id) AS ids, list(prob ORDER BY p DESC, cand_id) AS probs FROM {source} GROUP BY {keys})))), unnest(range(1, best + 1)) AS r(i)"""


def sql(select: str, *names: str, **more: str) -> str:
    """A query over named CTEs, with what they need before them."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in CTES[name][0]:
                visit(other)
            order.append(name)

    for name in names:
        visit(name)
    held = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return ("WITH " + ",\n".join(held) + "\n" if held else "") + select
