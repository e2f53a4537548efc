"""The registered queries again, in SQL over the same tables.

Each statement is a chain of named steps; only the steps a query needs are
written before its final SELECT.
"""

from __future__ import annotations

from peerlabel.checks import queries as q
from peerlabel.config import CoTrainConfig
from peerlabel.functions.hashing import WIDE_RANGE, WORD_RANGE
from peerlabel.functions.voting import MINMAX
from peerlabel.operators.bags import poisson_bounds
from peerlabel.sources import splits, views

K, C = q.K, q.C
SQL_ROUNDS = 9  # more than any run over the test tables takes; a longer one would not match


# -- expressions --------------------------------------------------------------


def word(row_id: str, salt: str, slot: str = "0") -> str:
    """The ``slot``-th 32-bit hash word of a row; ``slot`` may be a column."""
    digest = f"md5({row_id}::VARCHAR || ':{salt}:' || ({slot} // 4)::VARCHAR)"
    return f"('0x' || substr({digest}, ({8} * ({slot} % 4) + 1)::INTEGER, 8))::BIGINT"


def uniform(row_id: str, salt: str, slot: str = "0") -> str:
    return f"({word(row_id, salt, slot)}::DOUBLE / {WORD_RANGE}::DOUBLE)"


def wide_word(row_id: str, salt: str, slot: str) -> str:
    """The ``slot``-th 52-bit hash word of a row; ``slot`` may be a column."""
    digest = f"md5({row_id}::VARCHAR || ':{salt}:' || ({slot} // 2)::VARCHAR)"
    return f"('0x' || substr({digest}, (13 * ({slot} % 2) + 1)::INTEGER, 13))::BIGINT"


def wide_uniform(row_id: str, salt: str) -> str:
    digest = f"md5({row_id}::VARCHAR || ':{salt}')"
    return f"(('0x' || substr({digest}, 1, 13))::BIGINT::DOUBLE / {WIDE_RANGE}::DOUBLE)"


def bag_count(u: str) -> str:
    steps = " ".join(f"WHEN {u} < {b!r}::DOUBLE THEN {j}" for j, b in enumerate(poisson_bounds()))
    return f"CASE {steps} ELSE {len(poisson_bounds())} END"


def columns(template: str, n: int) -> str:
    return ", ".join(template.format(i=i) for i in range(n))


def statement(steps: list[tuple[str, str]], final: str) -> str:
    chain = ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in steps)
    return f"WITH {chain}\n{final}"


# -- steps --------------------------------------------------------------------


def docs_steps(weights=None) -> list[tuple[str, str]]:
    weights = weights or splits.TENTH
    flags = " + ".join(
        f"CASE WHEN contains(text, ' {w} ') THEN {1 << bit} ELSE 0 END"
        for bit, w in enumerate(views.STOP_WORDS)
    )
    label = " ".join(f"WHEN lang = '{lang}' THEN {i}" for i, lang in enumerate(views.LANGUAGES))
    bounds = splits.boundaries(weights)
    part = " ".join(f"WHEN u < {upper!r}::DOUBLE THEN '{name}'" for name, upper in bounds[:-1])
    masks = ", ".join(f"({k}, {m.mask})" for k, m in enumerate(q.flag_members()))
    classes = ", ".join(f"({c})" for c in range(C))
    return [
        (
            "docs",
            f"SELECT doc_id AS row_id, (CASE {label} END)::INTEGER AS label, ({flags})::INTEGER AS code, "
            f"{uniform('doc_id', f'{q.SEED}:split')} AS u FROM documents",
        ),
        ("parts", f"SELECT row_id, label, code, CASE {part} ELSE '{bounds[-1][0]}' END AS part FROM docs"),
        ("lab", f"SELECT row_id, label, code FROM parts WHERE part = '{splits.LABELLED}'"),
        ("unl", f"SELECT row_id, code FROM parts WHERE part = '{splits.UNLABELLED}'"),
        ("members", f"SELECT * FROM (VALUES {masks}) m(k, mask)"),
        ("classes", f"SELECT * FROM (VALUES {classes}) c(c)"),
        ("unl_size", "SELECT count(*) AS n FROM unl"),
    ]


def exact_bag_steps(source: str) -> list[tuple[str, str]]:
    return [
        (
            "dense",
            f"SELECT row_id, row_number() OVER (ORDER BY md5(row_id::VARCHAR || ':{q.SEED}:dense'), row_id) - 1 "
            f"AS pos FROM {source}",
        ),
        ("dense_size", "SELECT count(*) AS n FROM dense"),
        (
            "draws",
            f"SELECT d.id % {K} AS k, floor({wide_uniform('d.id', f'{q.SEED}:draw')} * s.n::DOUBLE)::BIGINT AS pos "
            f"FROM dense_size s, LATERAL (SELECT unnest(range(s.n * {K})) AS id) d",
        ),
        ("draw_counts", "SELECT k, pos, count(*) AS n FROM draws GROUP BY k, pos"),
    ]


def block_bag_steps(source: str) -> list[tuple[str, str]]:
    """Counts of draws within blocks of 10,000 positions."""
    begin = f"(d.id // {K}) // 10000 * 10000"
    u = wide_uniform("d.id", f"{q.SEED}:blockdraw")
    return [
        *exact_bag_steps(source)[:2],
        (
            "draws",
            f"SELECT d.id % {K} AS k, {begin} + floor({u} * least(10000, s.n - {begin})::DOUBLE)::BIGINT AS pos "
            f"FROM dense_size s, LATERAL (SELECT unnest(range(s.n * {K})) AS id) d",
        ),
        ("draw_counts", "SELECT k, pos, count(*) AS n FROM draws GROUP BY k, pos"),
    ]


def weighted_bag_steps(source: str) -> list[tuple[str, str]]:
    """Counts of draws by weight: rows as runs of whole units on a line, the heavy ones at its
    end, and the run in which a random unit lies."""
    return [
        ("units", f"SELECT row_id, floor(weight * pow(2, 51 - floor(log2((SELECT sum(weight) FROM {source})))) + 0.5)::BIGINT AS u FROM {source}"),
        (
            "line",
            "SELECT row_id, (sum(u) OVER (ORDER BY u > 137438953472, md5(row_id::VARCHAR || "
            f"':{q.SEED}:dense'), row_id) - u)::BIGINT AS start FROM units WHERE u > 0",
        ),
        ("whole", "SELECT count(*) AS n, sum(u)::BIGINT AS u FROM units"),
        (
            "draws",
            f"SELECT d.id % {K} AS k, floor({wide_uniform('d.id', f'{q.SEED}:wdraw')} * w.u::DOUBLE)::BIGINT AS unit "
            f"FROM whole w, LATERAL (SELECT unnest(range(w.n * {K})) AS id) d",
        ),
        ("draw_counts", "SELECT row_id, k, count(*) AS n FROM draws ASOF JOIN line ON unit >= start GROUP BY row_id, k"),
    ]


def bagged_steps(config: CoTrainConfig) -> list[tuple[str, str]]:
    if config.bootstrap == "poisson":
        u = uniform("row_id", f"{config.seed}:bag", "k")
        body = f"SELECT row_id, label, code, k, mask, ({bag_count('u')})::INTEGER AS bag FROM (" + (
            f"SELECT lab.*, k, mask, {u} AS u FROM lab, members)"
        )
        return [("bagged", body)]
    body = (
        "SELECT lab.row_id, label, code, m.k, mask, coalesce(dc.n, 0)::INTEGER AS bag FROM lab "
        "CROSS JOIN members m JOIN dense USING (row_id) "
        "LEFT JOIN draw_counts dc ON dc.k = m.k AND dc.pos = dense.pos"
    )
    return [*exact_bag_steps("lab"), ("bagged", body)]


def voter_steps(r: int, training: str) -> list[tuple[str, str]]:
    """Votes of round ``r`` by members trained on ``training`` (k, mask, code, label, w);
    members absent from it keep their vote of the round before."""
    win = "row_number() OVER (PARTITION BY {keys} ORDER BY sum(w) DESC, label)"
    ranked_bucket = (
        f"SELECT k, code & mask AS bucket, label, {win.format(keys='k, code & mask')} AS rk "
        f"FROM {training} GROUP BY k, code & mask, label HAVING sum(w) > 0"
    )
    ranked_all = (
        f"SELECT k, label, {win.format(keys='k')} AS rk FROM {training} GROUP BY k, label HAVING sum(w) > 0"
    )
    kept = "NULL" if r == 0 else "old.vote"
    before = "" if r == 0 else f"LEFT JOIN votes_{r - 1} old ON old.row_id = d.row_id AND old.k = m.k"
    return [
        (f"buckets_{r}", f"SELECT k, bucket, label FROM ({ranked_bucket}) WHERE rk = 1"),
        (f"overall_{r}", f"SELECT k, label FROM ({ranked_all}) WHERE rk = 1"),
        (
            f"votes_{r}",
            f"SELECT d.row_id, m.k, coalesce(b.label, o.label, {kept})::INTEGER AS vote FROM docs d "
            f"CROSS JOIN members m LEFT JOIN buckets_{r} b ON b.k = m.k AND b.bucket = d.code & m.mask "
            f"LEFT JOIN overall_{r} o ON o.k = m.k {before}",
        ),
    ]


def first_voter_steps(config: CoTrainConfig, weights=None) -> list[tuple[str, str]]:
    return [
        *docs_steps(weights),
        *bagged_steps(config),
        ("bag_rows", "SELECT k, mask, code, label, bag AS w FROM bagged WHERE bag > 0"),
        *voter_steps(0, "bag_rows"),
    ]


def decision_steps(name: str, sums: str, normaliser: str) -> list[tuple[str, str]]:
    """``{name}_dist`` (row_id, k, c, p) and ``{name}`` (row_id, k, confidence, decision)
    from class sums (row_id, k, c, s); rows without any vote stay zero."""
    w = "OVER (PARTITION BY row_id, k)"
    low = f"min(s) {w}" if normaliser == MINMAX else "0"
    span = f"(max(s) {w} - min(s) {w})" if normaliser == MINMAX else f"sum(s) {w}"
    fallback = C - 1 if normaliser == MINMAX else 0
    return [
        (
            f"{name}_dist",
            f"SELECT row_id, k, c, CASE WHEN sum(s) {w} = 0 THEN 0::DOUBLE "
            f"ELSE (s - {low})::DOUBLE / nullif({span}, 0)::DOUBLE END AS p FROM {sums}",
        ),
        (f"{name}_top", f"SELECT row_id, k, max(p) AS confidence FROM {name}_dist GROUP BY row_id, k"),
        (
            name,
            f"SELECT t.row_id, t.k, t.confidence, coalesce(min(d.c) FILTER (WHERE d.p = t.confidence), "
            f"{fallback})::INTEGER AS decision FROM {name}_top t JOIN {name}_dist d "
            f"ON d.row_id = t.row_id AND d.k = t.k GROUP BY t.row_id, t.k, t.confidence",
        ),
    ]


def sums_sql(votes: str, keep: str, among: str = "", bags: bool = False) -> str:
    """Class sums per (row, judged member); ``keep`` picks the voters ``v.k`` for ``t.k``."""
    bag = "JOIN bagged b ON b.row_id = v.row_id AND b.k = v.k" if bags else ""
    return (
        f"SELECT v.row_id, t.k, c.c, sum(CASE WHEN {keep} AND v.vote = c.c THEN 1 ELSE 0 END) AS s "
        f"FROM {votes} v {bag} CROSS JOIN members t CROSS JOIN classes c {among} GROUP BY v.row_id, t.k, c.c"
    )


def out_of_bag_steps(r: int, config: CoTrainConfig) -> list[tuple[str, str]]:
    return [
        (f"oob_sums_{r}", sums_sql(f"votes_{r}", "v.k <> t.k AND b.bag = 0", bags=True)),
        *decision_steps(f"oob_{r}", f"oob_sums_{r}", config.normaliser),
        (
            f"errors_{r}",
            "SELECT k, counted, wrong, wrong::DOUBLE / nullif(counted, 0)::DOUBLE AS err FROM ("
            f"SELECT o.k, sum((coalesce(confidence, 0) > {config.threshold}::DOUBLE)::INTEGER)::BIGINT AS counted, "
            f"sum((coalesce(confidence, 0) > {config.threshold}::DOUBLE AND decision <> label)::INTEGER)::BIGINT "
            f"AS wrong FROM oob_{r} o JOIN lab USING (row_id) GROUP BY o.k)",
        ),
    ]


def ensemble_steps(r: int, normaliser: str) -> list[tuple[str, str]]:
    """``ens_{r}`` with the whole group's decision, under ``k`` = -1."""
    return [
        (
            f"ens_sums_{r}",
            f"SELECT row_id, -1 AS k, c, sum((vote = c)::INTEGER) AS s FROM votes_{r}, classes GROUP BY row_id, c",
        ),
        *decision_steps(f"ens_{r}", f"ens_sums_{r}", normaliser),
    ]


def train_error_steps(r: int) -> list[tuple[str, str]]:
    return [
        (
            f"train_{r}",
            "SELECT count(*) AS n_rows, sum((decision <> label)::INTEGER)::BIGINT AS missed, "
            f"avg((decision <> label)::INTEGER::DOUBLE) AS train_error FROM ens_{r} JOIN lab USING (row_id)",
        )
    ]


def opened_step(r: int, config: CoTrainConfig) -> tuple[str, str]:
    """Gate 1, the earlier weight in force and the draw size."""
    initial = "least((SELECT n FROM unl_size) / 10, 100)"
    initial = f"{initial}::DOUBLE" if config.init_s_prime is None else f"{config.init_s_prime}::DOUBLE"
    state = (
        "SELECT k, 0.5::DOUBLE AS err_prev, 0::DOUBLE AS s_prev FROM members" if r == 0 else f"SELECT * FROM state_{r}"
    )
    return (
        f"opened_{r}",
        "SELECT k, err, err_prev, gate1, s_prev, CASE WHEN NOT gate1 THEN 0 "
        "WHEN err = 0 THEN (SELECT n FROM unl_size) "
        "ELSE least(ceil(err_prev * s_prev / err - 1), (SELECT n FROM unl_size)) END::BIGINT AS n FROM ("
        "SELECT k, err, err_prev, gate1, CASE WHEN gate1 AND s_prev = 0 "
        f"THEN {initial} ELSE s_prev END AS s_prev FROM (SELECT e.k, e.err, s.err_prev, s.s_prev, "
        f"coalesce(e.err < s.err_prev, false) AS gate1 FROM errors_{r} e JOIN ({state}) s ON s.k = e.k))",
    )


def drawn_sql(source: str, sizes: str, n_rows: str, salt: str, method: str) -> str:
    """``(k, row_id)`` drawn from ``source`` given ``sizes`` (k, n)."""
    if method == "bernoulli":
        accepted = f"least({WIDE_RANGE}::HUGEINT, (n::HUGEINT * {WIDE_RANGE} + ({n_rows}) - 1) // ({n_rows}))"
        return f"SELECT k, row_id FROM {source}, {sizes} WHERE {wide_word('row_id', salt, 'k')} < {accepted}"
    ranked = (
        f"SELECT k, row_id, n, row_number() OVER (PARTITION BY k ORDER BY {word('row_id', salt, 'k')}, row_id) AS rk "
        f"FROM {source}, {sizes}"
    )
    return f"SELECT k, row_id FROM ({ranked}) WHERE rk <= n"


def pseudo_label_steps(r: int, config: CoTrainConfig) -> list[tuple[str, str]]:
    salt = f"{config.seed}:sub:{r}"
    # A round exists only if someone changed in the one before.
    going = "true" if r == 0 else f"(SELECT bool_or(updated) FROM closed_{r - 1})"
    return [
        opened_step(r, config),
        (f"sizes_{r}", f"SELECT k, n FROM opened_{r} WHERE gate1"),
        (f"drawn_{r}", drawn_sql("unl", f"sizes_{r}", "SELECT n FROM unl_size", salt, config.subsample)),
        (f"loo_sums_{r}", sums_sql(f"votes_{r}", "v.k <> t.k", "JOIN unl u ON u.row_id = v.row_id")),
        *decision_steps(f"loo_{r}", f"loo_sums_{r}", config.normaliser),
        (
            f"li_{r}",
            f"SELECT l.k, l.row_id, l.decision AS pseudo_label, l.confidence FROM loo_{r} l "
            f"JOIN drawn_{r} d ON d.row_id = l.row_id AND d.k = l.k "
            f"WHERE l.confidence > {config.threshold}::DOUBLE",
        ),
        (
            f"weights_{r}",
            "SELECT m.k, count(l.row_id) AS li_size, coalesce(sum(l.confidence), 0)::DOUBLE AS s "
            f"FROM members m LEFT JOIN li_{r} l ON l.k = m.k GROUP BY m.k",
        ),
        (
            f"closed_{r}",
            f"SELECT *, gate1 AND gate2 AND gate3 AND {going} AS updated FROM (SELECT o.*, w.li_size, w.s, "
            "gate1 AND s_prev < li_size AS gate2, gate1 AND coalesce(err * s < err_prev * s_prev, false) AS gate3 "
            f"FROM opened_{r} o JOIN weights_{r} w ON w.k = o.k)",
        ),
    ]


def retrain_steps(r: int, config: CoTrainConfig) -> list[tuple[str, str]]:
    weight = "confidence" if config.retrain_weights else "1::DOUBLE"
    return [
        (
            f"retrain_{r}",
            f"SELECT c.k, m.mask, lab.row_id, lab.code, lab.label, 1::DOUBLE AS w FROM closed_{r} c "
            "JOIN members m ON m.k = c.k, lab WHERE updated UNION ALL "
            f"SELECT c.k, m.mask, l.row_id, u.code, l.pseudo_label, {weight} FROM closed_{r} c "
            f"JOIN members m ON m.k = c.k JOIN li_{r} l ON l.k = c.k JOIN unl u ON u.row_id = l.row_id WHERE updated",
        ),
        (
            f"state_{r + 1}",
            "SELECT k, CASE WHEN updated THEN err ELSE err_prev END AS err_prev, "
            f"CASE WHEN updated THEN s ELSE s_prev END AS s_prev FROM closed_{r}",
        ),
        *voter_steps(r + 1, f"retrain_{r}"),
    ]


def loop_steps(config: CoTrainConfig, weights=None) -> list[tuple[str, str]]:
    """The whole loop, SQL_ROUNDS rounds written out; ``votes_{SQL_ROUNDS}`` are the last."""
    steps = first_voter_steps(config, weights)
    for r in range(SQL_ROUNDS):
        steps += out_of_bag_steps(r, config) + ensemble_steps(r, config.normaliser) + train_error_steps(r)
        steps += pseudo_label_steps(r, config) + retrain_steps(r, config)
    return steps + ensemble_steps(SQL_ROUNDS, config.normaliser)


def history_sql(config: CoTrainConfig) -> str:
    selects = []
    for r in range(SQL_ROUNDS):
        went_on = "" if r == 0 else f"WHERE EXISTS (SELECT 1 FROM closed_{r - 1} WHERE updated)"
        selects.append(
            f"SELECT {r}::INTEGER AS round, k::INTEGER AS k, err, err_prev, n, li_size, s, s_prev, gate1, gate2, "
            f"gate3, updated, train_error FROM closed_{r} CROSS JOIN train_{r} {went_on}"
        )
    return statement(loop_steps(config), " UNION ALL ".join(selects))


def test_error_sql(config: CoTrainConfig) -> str:
    test = f"JOIN parts USING (row_id) WHERE part = '{splits.TEST}'"
    wrong = "sum((decision <> label)::INTEGER)::BIGINT"
    selects = [
        f"SELECT '{stage}' AS stage, count(*) AS n_rows, {wrong} AS wrong, {wrong}::DOUBLE / count(*)::DOUBLE AS error "
        f"FROM ens_{r} {test}"
        for stage, r in (("first", 0), ("last", SQL_ROUNDS))
    ]
    return statement(loop_steps(config, splits.TENTH_AND_TEST), " UNION ALL ".join(selects))


def code_steps(rows: str) -> list[tuple[str, str]]:
    """Classes of each code in ``rows`` (code, label, w): heaviest, whether alone, shares."""
    return [
        ("code_weights", f"SELECT code, label, sum(w) AS w FROM {rows} GROUP BY code, label"),
        (
            "codes",
            "SELECT code, arg_max(label, w) AS heaviest, count(*) FILTER (WHERE w = top) = 1 AS untied FROM ("
            "SELECT *, max(w) OVER (PARTITION BY code) AS top FROM code_weights) GROUP BY code",
        ),
    ]


def tree_steps() -> list[tuple[str, str]]:
    """Random trees grown level by level: ``at_{d}`` has the node of every document in the tree of each
    member, ``leaves`` the classes of the training rows in each."""
    counted = ", ".join(f"({j}, '{part}')" for j, part in enumerate(views.COUNTED))
    classes = range(C)
    listed = lambda side: [f"{side}{c}" for c in classes]

    def purity(side):
        return f"(({' + '.join(f'{x} * {x}' for x in listed(side))}) / ({' + '.join(listed(side))}))"

    steps = [
        (
            "feats",
            "SELECT doc_id AS row_id, j, least((length(t) - length(replace(t, s, ''))) // length(s), "
            f"{views.MOST_COUNTED})::INTEGER AS x FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), "
            f"(VALUES {counted}) f(j, s)",
        ),
        ("train", f"SELECT row_id, k, label, bag::DOUBLE AS w FROM bagged WHERE bag > 0 AND k < {q.N_TREES}"),
        ("at_0", f"SELECT row_id, k, 1 AS node FROM docs, members WHERE k < {q.N_TREES}"),
    ]
    for d in range(q.TREE_DEPTH):
        steps += [
            (f"open_{d}", f"SELECT DISTINCT k, node FROM at_{d} JOIN train USING (row_id, k) WHERE node >= {1 << d}"),
            (
                f"chosen_{d}",
                "SELECT k, node, j FROM (SELECT k, node, j, row_number() OVER (PARTITION BY k, node ORDER BY "
                f"md5(j || ':{q.SEED}:node:' || k || ':' || node)) AS rk FROM open_{d}, "
                f"(SELECT unnest(range({len(views.COUNTED)})) AS j)) WHERE rk <= {q.TREE_FEATURES}",
            ),
            (
                f"hist_{d}",
                f"SELECT k, node, j, x, {columns('coalesce(sum(w) FILTER (label = {i}), 0) AS n{i}', C)} "
                f"FROM train JOIN at_{d} USING (row_id, k) JOIN chosen_{d} USING (k, node) JOIN feats USING (row_id, j) "
                "GROUP BY k, node, j, x",
            ),
            (
                f"sides_{d}",
                "SELECT *, " + columns("t{i} - l{i} AS r{i}", C) + " FROM (SELECT k, node, j, x, "
                + columns("sum(n{i}) OVER (PARTITION BY k, node, j ORDER BY x) AS l{i}", C) + ", "
                + columns("sum(n{i}) OVER (PARTITION BY k, node, j) AS t{i}", C) + f" FROM hist_{d})",
            ),
            (
                f"split_{d}",
                "SELECT k, node, j, x FROM (SELECT *, row_number() OVER (PARTITION BY k, node ORDER BY score DESC, j, x) AS rk "
                f"FROM (SELECT k, node, j, x, {purity('l')} + {purity('r')} AS score, {purity('t')} AS pure FROM sides_{d} "
                f"WHERE {' + '.join(listed('r'))} > 0)) WHERE rk = 1 AND score > pure * (1::DOUBLE + 1e-12::DOUBLE)",
            ),
            (
                f"at_{d + 1}",
                "SELECT a.row_id, a.k, CASE WHEN s.node IS NULL THEN a.node ELSE 2 * a.node + (f.x > s.x)::INTEGER END AS node "
                f"FROM at_{d} a LEFT JOIN split_{d} s ON s.k = a.k AND s.node = a.node "
                "LEFT JOIN feats f ON f.row_id = a.row_id AND f.j = s.j",
            ),
        ]
    final = f"at_{q.TREE_DEPTH}"
    sums = columns("coalesce(sum(w) FILTER (label = {i}), 0) AS n{i}", C)
    return [*steps, ("leaves", f"SELECT k, node, {sums}, sum(w) AS n FROM train JOIN {final} USING (row_id, k) GROUP BY k, node")]


def spread_dist(name: str, keys: str) -> str:
    values = columns("max(p) FILTER (WHERE c = {i}) AS p_{i}", C)
    return f"SELECT {keys}, {values} FROM {name}_dist GROUP BY {keys}"


def spread_votes(votes: str) -> str:
    values = columns("max(vote) FILTER (WHERE k = {i}) AS vote_{i}", K)
    return f"SELECT row_id, {values} FROM {votes} GROUP BY row_id"


# -- one statement per query --------------------------------------------------


def all_sql() -> dict[str, str]:
    config = q.CONFIG
    first = first_voter_steps(config)
    errors = first + out_of_bag_steps(0, config)
    round0 = errors + pseudo_label_steps(0, config)
    loo = [("loo_sums", sums_sql("votes_0", "v.k <> t.k"))]
    bag = bag_count("u")
    event_u = uniform("event_id", f"{q.SEED}:bag", "k")
    ks = f"(SELECT unnest(range({K}))::INTEGER AS k) m"
    event_bags = [
        ("u", f"SELECT event_id AS row_id, k, {event_u} AS u FROM events, {ks}"),
        ("bags", f"SELECT row_id, k, ({bag})::INTEGER AS bag FROM u"),
    ]
    spread_bags = f"SELECT row_id, {columns('max(bag) FILTER (WHERE k = {i}) AS bag_{i}', K)} FROM bags GROUP BY row_id"
    event_sizes = [
        ("ids", "SELECT event_id AS row_id FROM events"),
        ("ids_size", "SELECT count(*) AS n FROM ids"),
        ("sizes", f"SELECT k, n * (k + 1) // 20 AS n FROM ids_size, {ks}"),
    ]
    sub0 = f"{q.SEED}:sub:0"
    pairs = "SELECT k, row_id FROM drawn"

    line_sums = (
        "s",
        "SELECT l_orderkey, l_linenumber, l_quantity AS s_0, (l_linenumber * 7)::DOUBLE AS s_1, "
        "(l_partkey % 50)::DOUBLE AS s_2, (l_suppkey % 50)::DOUBLE AS s_3 FROM lineitem",
    )
    low, high = "least(s_0, s_1, s_2, s_3)", "greatest(s_0, s_1, s_2, s_3)"
    line_minmax = columns(f"(s_{{i}} - {low}) / nullif({high} - {low}, 0) AS minmax_{{i}}", 4)
    line_share = columns("s_{i} / nullif(s_0 + s_1 + s_2 + s_3, 0) AS share_{i}", 4)
    lines = [line_sums, ("d", f"SELECT l_orderkey, l_linenumber, {line_minmax}, {line_share} FROM s")]

    def winner(prefix, fallback):
        top = f"greatest({columns(prefix + '_{i}', 4)})"
        ranks = " ".join(f"WHEN {prefix}_{c} = {top} THEN {c}" for c in range(4))
        return f"(CASE {ranks} ELSE {fallback} END)::INTEGER AS winner_{prefix}"

    fields = (
        "l_linenumber::VARCHAR || ',' || l_quantity::INTEGER::VARCHAR || ',' || l_partkey::VARCHAR || ',' || "
        "l_suppkey::VARCHAR"
    )
    csv = ("csv", f"SELECT {fields} AS features, (l_linenumber - 1)::VARCHAR AS label FROM lineitem")
    numbers = ("numbers", "SELECT string_split(features, ',')::DOUBLE[] AS f, label::DOUBLE AS label FROM csv")

    one_hot = columns("(CASE WHEN vote = {i} THEN 1 ELSE 0 END)::DOUBLE AS v_{i}", C)
    ens = first + ensemble_steps(0, config.normaliser)
    judged = "SELECT e.row_id, e.decision AS prediction, docs.label FROM ens_0 e JOIN docs ON docs.row_id = e.row_id"

    return {
        "a1_parse_features": statement(
            [csv, numbers], "SELECT f[1] AS f_0, f[2] AS f_1, f[3] AS f_2, f[4] AS f_3, label FROM numbers"
        ),
        "a4_split": statement(
            docs_steps(),
            f"SELECT row_id, part, CASE WHEN part = '{splits.LABELLED}' THEN label ELSE -1 END AS label FROM parts",
        ),
        "a6_sizes": statement(docs_steps(), "SELECT part, count(*) AS n_rows FROM parts GROUP BY part"),
        "b1_bag_counts": statement(event_bags, spread_bags),
        "b2_exact_bootstrap": statement(
            [("ids", "SELECT o_orderkey AS row_id FROM orders"), *exact_bag_steps("ids")],
            "SELECT row_id, "
            + columns("coalesce(max(n) FILTER (WHERE k = {i}), 0)::INTEGER AS bag_{i}", K)
            + " FROM dense LEFT JOIN draw_counts USING (pos) GROUP BY row_id",
        ),
        "b1_block_bags": statement(
            [("ids", "SELECT event_id AS row_id FROM events"), *block_bag_steps("ids")],
            "SELECT row_id, "
            + columns("coalesce(max(n) FILTER (WHERE k = {i}), 0)::INTEGER AS bag_{i}", K)
            + " FROM dense LEFT JOIN draw_counts USING (pos) GROUP BY row_id",
        ),
        "b2_weighted_bootstrap": statement(
            [("prices", "SELECT o_orderkey AS row_id, o_totalprice AS weight FROM orders"), *weighted_bag_steps("prices")],
            "SELECT row_id, "
            + columns("coalesce(max(n) FILTER (WHERE k = {i}), 0)::INTEGER AS bag_{i}", K)
            + " FROM prices LEFT JOIN draw_counts USING (row_id) GROUP BY row_id",
        ),
        "b3_inbag_rows": statement(
            event_bags,
            "SELECT row_id, k, 1::DOUBLE AS weight FROM (SELECT row_id, k, unnest(range(bag)) FROM bags)",
        ),
        "b4_oob_flags": statement(
            event_bags,
            f"SELECT row_id, {columns('bool_or(bag > 0) FILTER (WHERE k = {i}) AS in_bag_{i}', K)}, "
            "1::DOUBLE AS weight FROM bags GROUP BY row_id",
        ),
        "b5_bag_summary": statement(
            event_bags,
            "SELECT k, sum(bag)::BIGINT AS bag_size, count(*) FILTER (WHERE bag > 0) AS in_bag_rows, "
            "count(*) FILTER (WHERE bag = 0) AS out_of_bag_rows FROM bags GROUP BY k",
        ),
        "c1_bucket_votes": statement(first, spread_votes("votes_0")),
        "c2_lr_member": statement(
            [*first, ("bag_0", "SELECT * FROM bag_rows WHERE k = 0"), *code_steps("bag_0")],
            "SELECT row_id, coalesce(untied, false) AS settled, "
            + columns("CASE WHEN untied THEN (heaviest = {i})::INTEGER::DOUBLE END AS v_{i}", C)
            + " FROM docs LEFT JOIN codes USING (code)",
        ),
        "c4_tree_member": statement(
            [*first, ("bag_0", "SELECT * FROM bag_rows WHERE k = 0"), *code_steps("bag_0")],
            "SELECT row_id, count(w) > 0 AS settled, "
            + columns(
                "CASE WHEN count(w) > 0 THEN "
                "round(coalesce(sum(w) FILTER (WHERE c.label = {i}), 0)::DOUBLE / sum(w)::DOUBLE, 9) END AS v_{i}",
                C,
            )
            + " FROM docs LEFT JOIN code_weights c USING (code) GROUP BY row_id",
        ),
        "c4_tree_grown": statement(
            [*first, *tree_steps()],
            f"SELECT row_id, a.k::INTEGER AS k, {columns('round(n{i} / n, 9) AS v_{i}', C)} "
            f"FROM at_{q.TREE_DEPTH} a JOIN leaves l ON l.k = a.k AND l.node = a.node",
        ),
        "c7_baseline_error": statement(
            [
                *docs_steps(splits.TENTH_AND_TEST),
                ("known", f"SELECT code, label, 1 AS w FROM parts WHERE part <> '{splits.TEST}'"),
                *code_steps("known"),
                (
                    "tested",
                    "SELECT coalesce(untied, false) AS settled, coalesce(untied AND heaviest <> label, false) AS missed "
                    f"FROM parts LEFT JOIN codes USING (code) WHERE part = '{splits.TEST}'",
                ),
            ],
            "SELECT count(*) AS n_rows, count(*) FILTER (settled) AS n_settled, count(*) FILTER (missed) AS wrong, "
            "count(*) FILTER (missed)::DOUBLE / count(*) FILTER (settled)::DOUBLE AS error FROM tested",
        ),
        "c3_hard_vote": statement(first, f"SELECT row_id, {one_hot} FROM votes_0 WHERE k = 0"),
        "c5_subspace_sizes": statement(
            [csv, numbers],
            "SELECT n_features, count(*) AS n_rows, ceil(ln(n_features) / ln(2) + 1)::INTEGER AS size_ceil, "
            "floor(ln(n_features + 1) / ln(2))::INTEGER + 1 AS size_floor "
            "FROM (SELECT len(f)::INTEGER AS n_features FROM numbers) GROUP BY n_features",
        ),
        "c6_round0_state": statement(
            first,
            "SELECT b.k, 0.5::DOUBLE AS err_prev, 0::DOUBLE AS s_prev, sum(bag)::DOUBLE AS bag_weight, "
            "sum(CASE WHEN v.vote <> b.label THEN bag ELSE 0 END)::DOUBLE AS bag_wrong "
            "FROM bagged b JOIN votes_0 v ON v.row_id = b.row_id AND v.k = b.k GROUP BY b.k",
        ),
        "d1_member_votes": statement(first, f"SELECT row_id, k, {one_hot} FROM votes_0"),
        "d2_ensemble_dist": statement(first + ensemble_steps(0, "sum"), spread_dist("ens_0", "row_id")),
        "d3_loo_dist": statement(
            first + loo + decision_steps("loo", "loo_sums", config.normaliser), spread_dist("loo", "row_id, k")
        ),
        "d2_scored_dist": statement(
            round0 + retrain_steps(0, config) + ensemble_steps(1, config.normaliser),
            f"SELECT row_id, {columns('max(p) FILTER (WHERE c = {i}) AS p_{i}', C)}, any_value(decision) AS prediction "
            "FROM ens_1_dist JOIN ens_1 USING (row_id) GROUP BY row_id",
        ),
        "d3_soft_loo": statement(
            [
                *first,
                (
                    "shares",
                    "SELECT k, code & mask AS bucket, label, sum(w)::DOUBLE / sum(sum(w)) OVER (PARTITION BY k, code & mask) "
                    "AS p FROM bag_rows GROUP BY k, code & mask, label",
                ),
                (
                    "overall",
                    "SELECT k, label, sum(w)::DOUBLE / sum(sum(w)) OVER (PARTITION BY k) AS p FROM bag_rows GROUP BY k, label",
                ),
                (
                    "soft",
                    "SELECT d.row_id, m.k, c.c, coalesce(CASE WHEN EXISTS (SELECT 1 FROM shares x WHERE x.k = m.k AND "
                    "x.bucket = d.code & m.mask) THEN s.p ELSE o.p END, 0)::DOUBLE AS p FROM docs d CROSS JOIN members m "
                    "CROSS JOIN classes c "
                    "LEFT JOIN shares s ON s.k = m.k AND s.bucket = d.code & m.mask AND s.label = c.c "
                    "LEFT JOIN overall o ON o.k = m.k AND o.label = c.c",
                ),
                (
                    "soft_sums",
                    "SELECT row_id, t.k, c, sum(p) FILTER (WHERE soft.k <> t.k) AS s FROM soft CROSS JOIN members t "
                    "GROUP BY row_id, t.k, c",
                ),
                *decision_steps("soft_loo", "soft_sums", "sum"),
            ],
            f"SELECT row_id, k, {columns('round(max(p) FILTER (WHERE c = {i}), 9) AS p_{i}', C)} "
            "FROM soft_loo_dist GROUP BY row_id, k",
        ),
        "d4_oob_loo_dist": statement(errors, spread_dist("oob_0", "row_id, k")),
        "d5_normalise_minmax": statement(
            lines, f"SELECT l_orderkey, l_linenumber, {columns('minmax_{i}', 4)} FROM d"
        ),
        "d6_normalise_sum": statement(
            lines, f"SELECT l_orderkey, l_linenumber, {columns('share_{i}', 4)} FROM d"
        ),
        "d7_argmax": statement(
            lines, f"SELECT l_orderkey, l_linenumber, {winner('minmax', 3)}, {winner('share', 0)} FROM d"
        ),
        "d8_confidence": statement(
            lines,
            f"SELECT l_orderkey, l_linenumber, greatest({columns('minmax_{i}', 4)}) AS confidence_minmax, "
            f"greatest({columns('share_{i}', 4)}) AS confidence_share FROM d",
        ),
        "d9_classify": statement(ens, "SELECT row_id, decision AS prediction FROM ens_0"),
        "d10_high_confidence": statement(
            first + loo + decision_steps("loo", "loo_sums", "sum"),
            f"SELECT row_id, k, confidence > {config.threshold}::DOUBLE AS is_confident, "
            f"CASE WHEN confidence > {config.threshold}::DOUBLE THEN decision ELSE -1 END AS label, "
            f"CASE WHEN confidence > {config.threshold}::DOUBLE THEN confidence ELSE 0 END AS confidence FROM loo",
        ),
        "e1_oob_error": statement(errors, "SELECT * FROM errors_0"),
        "e1_weighted_error": statement(
            [
                *errors,
                (
                    "weighed",
                    f"SELECT o.k, decision, label, coalesce(confidence, 0) > {config.threshold}::DOUBLE AS sure, "
                    "(row_id % 5 + 1)::DOUBLE / 3::DOUBLE AS w FROM oob_0 o JOIN lab USING (row_id)",
                ),
            ],
            "SELECT k, counted, wrong, wrong / nullif(counted, 0) AS err FROM (SELECT k, "
            "coalesce(sum(w) FILTER (WHERE sure), 0)::DOUBLE AS counted, "
            "coalesce(sum(w) FILTER (WHERE sure AND decision <> label), 0)::DOUBLE AS wrong FROM weighed GROUP BY k)",
        ),
        "e2_draw_size": statement(
            [*errors, opened_step(0, config)], "SELECT k, gate1, s_prev, n FROM opened_0"
        ),
        "e3_subsample_bernoulli": statement(
            [*event_sizes, ("drawn", drawn_sql("ids", "sizes", "SELECT n FROM ids_size", sub0, "bernoulli"))],
            pairs,
        ),
        "e4_subsample_exact": statement(
            [*event_sizes, ("drawn", drawn_sql("ids", "sizes", "SELECT n FROM ids_size", sub0, "exact"))], pairs
        ),
        "e4_weighted_draw": statement(
            [
                ("whole", "SELECT floor(sum(o_totalprice))::BIGINT AS w FROM orders"),
                ("sizes", f"SELECT k, w * (k + 1) // 20 AS n FROM whole, {ks}"),
                (
                    "upto",
                    "SELECT k, o_orderkey AS row_id, n, sum(o_totalprice) OVER (PARTITION BY k ORDER BY "
                    f"{word('o_orderkey', sub0, 'k')}, o_orderkey ROWS UNBOUNDED PRECEDING) AS w FROM orders, sizes",
                ),
            ],
            "SELECT k, row_id FROM upto WHERE w <= n",
        ),
        # Thirds of prices are whole multiples of 2^-60, which HUGEINT adds up exactly.
        "e5_exact_sums": "SELECT l_returnflag, l_linestatus, (s // 1152921504606846976)::DOUBLE "
        "+ (s % 1152921504606846976)::BIGINT::DOUBLE / pow(2, 60) AS s FROM ("
        "SELECT l_returnflag, l_linestatus, sum(CAST(l_extendedprice / 3::DOUBLE * pow(2, 60) AS HUGEINT)) AS s "
        "FROM lineitem GROUP BY l_returnflag, l_linestatus)",
        "e5_li_weight": statement(round0, "SELECT * FROM weights_0"),
        "e6_pseudo_labels": statement(round0, "SELECT k, row_id, pseudo_label, confidence FROM li_0"),
        "e8_gates": statement(
            round0,
            "SELECT k, err, err_prev, n, li_size, s, s_prev, gate1, gate2, gate3, updated FROM closed_0",
        ),
        "e9_retrain_set": statement(
            round0 + retrain_steps(0, config), "SELECT k, row_id, label, w AS weight FROM retrain_0"
        ),
        "e9_round1_votes": statement(round0 + retrain_steps(0, config), spread_votes("votes_1")),
        "e11_loop_history": history_sql(config),
        "e11_paper_history": history_sql(q.PAPER),
        "f1_test_error": test_error_sql(config),
        "g1_scored_test": statement(
            loop_steps(config, splits.TENTH_AND_TEST),
            f"SELECT row_id, label, decision AS prediction, confidence FROM ens_{SQL_ROUNDS} "
            f"JOIN parts USING (row_id) WHERE part = '{splits.TEST}'",
        ),
        "f1_error_rate": statement(
            [*ens, ("judged", judged)],
            "SELECT count(*) AS n_rows, sum((prediction <> label)::INTEGER)::BIGINT AS wrong, "
            "avg((prediction <> label)::INTEGER::DOUBLE) AS error FROM judged",
        ),
        "f2_error_by_class": statement(
            [*ens, ("judged", judged)],
            "SELECT label, count(*) AS n_rows, sum((prediction <> label)::INTEGER)::BIGINT AS wrong, "
            "sum((prediction <> label)::INTEGER)::DOUBLE / (SELECT count(*) FROM judged)::DOUBLE AS error_share "
            "FROM judged GROUP BY label",
        ),
        "f3_train_error": statement(
            ens + train_error_steps(0), "SELECT n_rows, missed, train_error FROM train_0"
        ),
    }
