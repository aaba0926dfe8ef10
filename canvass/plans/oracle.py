"""SQL counterparts of the queries, written for DuckDB and independently of the Spark plans.

Profiles are unions of plain group-bys, tests go through explicit expected
counts, tail probabilities through power series, and the regressions through
unrolled scoring steps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from canvass.plans import panel, survey


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


def bins(c: str, edges: Sequence[float], labels: Sequence[str]) -> str:
    whens = " ".join(f"when {c} < {e} then '{l}'" for e, l in zip(edges, labels))
    return f"case when {c} is null then null {whens} else '{labels[-1]}' end"


REVENUE_BINS = ((25000, 250000, 500000, 1000000, 5000000), survey.REVENUE.levels)

CUSTOMERS = f"""
spend as (
  select o_custkey, sum(cast(round(o_totalprice * 100) as bigint))::bigint as spend_cents, count(*) as n_orders
  from orders group by o_custkey),
cus as (
  select c.*, r_name, spend_cents, coalesce(n_orders, 0) as n_orders,
         cast(round(c_acctbal * 100) as bigint) as balance_cents,
         {bins('(spend_cents / 100.0::double)', *REVENUE_BINS)} as spend_bin,
         cast(c_acctbal > 0 as int) as in_credit, cast(c_acctbal > 5000 as int) as wealthy
  from customer c left join nation on c_nationkey = n_nationkey
  left join region on n_regionkey = r_regionkey left join spend on o_custkey = c_custkey)"""

DOCUMENTS = """
doc as (
  select d.doc_id, lang, source, n_chars, quality, toxic,
         case when n_chars < 500 then '<500' when n_chars < 2000 then '500-2K'
              when n_chars < 8000 then '2-8K' when n_chars is not null then '8K+' end as length,
         case quality when 0 then 'low' when 1 then 'high' end as label,
         cast(lang = 'en' as int) as english
  from documents d left join labels l on l.doc_id = d.doc_id)"""

LINES = """
li as (
  select *, cast(l_discount > 0.05 as int) as discounted, cast(l_tax = 0 as int) as untaxed,
         cast(l_quantity > 25 as int) as large, cast(l_returnflag = 'R' as int) as returned
  from lineitem)"""


def profile(rel: str, cuts: Sequence[tuple[str, str]], measures: Mapping[str, str],
            overall: str, count: str | None = "N") -> str:
    """One group-by per block."""
    shown = ([f'count(*) as "{count}"'] if count else []) + [f'{e} as "{n}"' for n, e in measures.items()]
    body = ", ".join(shown)
    blocks = [f"select '{overall}' as type, 'All' as level, {body} from {rel}"]
    blocks += [f"select '{label}', {c}, {body} from {rel} group by {c}" for c, label in cuts]
    return "\nunion all ".join(blocks)


def avg(c: str) -> str:
    """A mean of whole numbers, one exact division on both sides."""
    return f"avg({c})"


def total(c: str) -> str:
    return f"coalesce(sum({c}), 0)::bigint"


PROFILE_DOCUMENTS = profile(
    "doc", [("lang", "Language"), ("length", "Length"), ("label", "Label")],
    {"quality": avg("quality"), "toxic": avg("toxic"), "english": avg("english"), "toxic_docs": total("toxic")},
    "All documents")
PROFILE_SEGMENTS = profile(
    "cus", [("c_mktsegment", "Segment"), ("r_name", "Region"), ("spend_bin", "Spending")],
    {"balance_cents": avg("balance_cents"), "spend_cents": avg("spend_cents"), "in_credit": avg("in_credit"),
     "wealthy": avg("wealthy"), "orders": total("n_orders")}, "All customers")

CROSSTAB_COUNTS = """
        with o as (select o_orderstatus as level,
          case when o_orderpriority <> '4-NOT SPECIFIED' then o_orderpriority end as p from orders)
        select 'Status' as type, level, count(*) filter (p = '1-URGENT') as "1-URGENT",
          count(*) filter (p = '2-HIGH') as "2-HIGH", count(*) filter (p = '3-MEDIUM') as "3-MEDIUM",
          count(*) filter (p = '5-LOW') as "5-LOW", count(*) filter (p is null) as "NA",
          0::bigint as other, count(*) as "all"
        from o group by level"""

# --- special functions -----------------------------------------------------


def normal_cdf(x: str, terms: int = 60) -> str:
    """Power series 1/2 + pdf(x) * (x + x^3/3 + x^5/15 + ...), summed from the far end."""
    nested = (f"list_reduce(range({2 * terms + 1}, 1, -2)::double[], "
              f"lambda acc, k: 1 + ({x}) * ({x}) / k * acc, 1.0::double)")
    return f"(0.5 + exp(-0.5*({x})*({x})) / sqrt(2*pi()) * ({x}) * {nested})"


def chi2_tail(x: str, df: str) -> str:
    """Even df: Poisson sum. Odd df: erfc (series of erf near zero, continued fraction beyond) and the half-integer sum.

    Terms are formed from their logarithms, so no power or factorial overflows.
    """
    h = f"({x}/2.0)"
    erf = (f"2/sqrt(pi()) * exp(-{h}) * list_sum(list_transform(range(0, 250), lambda n: "
           f"exp((2*n+1)*ln(sqrt({h})) + n*ln(2.0) - (lgamma(2*n+2) - n*ln(2.0) - lgamma(n+1)))))")
    far = f"exp(-{h}) / sqrt(pi()) / list_reduce(range(200, 0, -1)::double[], lambda acc, k: sqrt({h}) + k / 2 / acc, sqrt({h}))"
    even = f"list_sum(list_transform(range(0, {df} // 2), lambda k: exp(k * ln({h}) - {h} - lgamma(k + 1))))"
    odd = (f"(case when {h} < 2 then 1 - {erf} else {far} end) + coalesce(list_sum(list_transform(range(1, ({df}-1) // 2 + 1), "
           f"lambda k: exp((k - 0.5) * ln({h}) - {h} - lgamma(k + 0.5)))), 0)")
    return (f"case when {x} is null then null when {x} <= 0 then 1.0 "
            f"when {df} % 2 = 0 then least({even}, 1.0) else least({odd}, 1.0) end")


def t_quantile(z: float, nu: str) -> str:
    c = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96,
         (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
         (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    return f"{z!r}::double + " + " + ".join(f"{v!r}::double / pow({nu}, {i})" for i, v in enumerate(c, 1))


def interval(source: str, c: str, digits: int) -> str:
    stats = f"select count(*) as n, avg({c}) as mu, stddev_samp({c}) as sigma from {source} where {c} is not null"
    parts = f"select *, sigma / sqrt(n) as se, {t_quantile(1.959963984540054, '(n - 1)')} as m from ({stats})"
    shown = {"mu": "mu", "sigma": "sigma", "se": "se", '"ciMult"': "m", "ci": "se * m",
             "upper": "mu + se * m", "lower": "mu - se * m"}
    return "select n, " + ", ".join(f"{r(e, digits)} as {n}" for n, e in shown.items()) + f" from ({parts})"


def interval_by(source: str, c: str, by: str, p: float, digits: int) -> str:
    """Per group, with the t quantile found by bisecting the finite trigonometric series."""
    angle, cosine = "atan(mid / sqrt(nu))", "sqrt(nu / (nu + mid * mid))"
    even = (f"sin({angle}) * list_sum(list_transform(range(0, nu // 2), "
            f"lambda k: gamma(k + 0.5) / gamma(k + 1) / sqrt(pi()) * pow({cosine}, 2 * k)))")
    odd = (f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(range(0, (nu - 1) // 2), "
           f"lambda k: sqrt(pi()) / 2 * gamma(k + 1) / gamma(k + 1.5) * pow({cosine}, 2 * k + 1))), 0))")
    area = f"0.5 + 0.5 * (case when nu % 2 = 0 then {even} else {odd} end)"
    shown = {"mu": "mu", "sigma": "sigma", "se": "se", '"ciMult"': "m", "ci": "se * m",
             "upper": "mu + se * m", "lower": "mu - se * m"}
    return f"""
recursive_seed as (select {by}, count(*) as n, avg({c}) as mu, stddev_samp({c}) as sigma
                   from {source} where {c} is not null group by {by}),
search as (
  select distinct n - 1 as nu, 0.0::double as lo, 1000.0::double as hi, 0 as step from recursive_seed where n > 1
  union all
  select nu, case when area < {p} then mid else lo end, case when area < {p} then hi else mid end, step + 1
  from (select *, {area} as area from (select *, (lo + hi) / 2 as mid from search where step < 70)))
select {by}, n, {", ".join(f"{r(e, digits)} as {k}" for k, e in shown.items())}
from (select q.*, sigma / sqrt(n) as se, lo as m from recursive_seed q
      left join (select * from search where step = 70) on nu = n - 1)"""


# --- chi-squared -----------------------------------------------------------


def chi2(pairs: Sequence[tuple[str, str, str]]) -> str:
    """CTEs for tests over (relation, cut, response) triples, then the result rows."""
    cells = "\nunion all ".join(
        f"select '{x}' as cut, '{y}' as resp, cast({x} as varchar) as lvl, cast({y} as varchar) as y, count(*) as o "
        f"from {rel} where {x} is not null and {y} is not null group by {x}, {y}" for rel, x, y in pairs)
    return f"""
tests(cut, resp) as (values {", ".join(f"('{x}', '{y}')" for _, x, y in pairs)}),
cells as materialized ({cells}),
rows_ as (select cut, resp, lvl, sum(o)::double as r from cells group by all),
cols_ as (select cut, resp, y, sum(o)::double as c from cells group by all),
whole as (select cut, resp, sum(o)::double as n, count(distinct lvl) as nr, count(distinct y) as nc
          from cells group by all),
grid as (
  select cut, resp, nr, nc, coalesce(o, 0) as o, r * c / n as e
  from rows_ join cols_ using (cut, resp) join whole using (cut, resp)
  left join cells using (cut, resp, lvl, y)),
stats as (
  select cut, resp, (nr - 1) * (nc - 1) as df,
         case when nr = 2 and nc = 2 then sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e)
              else sum(pow(o - e, 2) / e) end as stat
  from grid where nr > 1 and nc > 1 group by cut, resp, nr, nc),
tails as (select cut, resp, stat, df, {chi2_tail('stat', 'df')} as pval from stats)
select w.cut, w.resp, {r('stat')} as stat, cast(df as int) as df, {r('pval')} as pval,
       case when pval > 0 then {r('log10(pval)')} end as log_p,
       case when pval is null then null when pval <= 0.05 then '*' else '' end as sig
from (select distinct cut, resp from whole) w left join tails t on t.cut = w.cut and t.resp = w.resp"""


def all_pairs(rel: str, cuts: Sequence[str], responses: Sequence[str]) -> list[tuple[str, str, str]]:
    return [(rel, x, y) for x in cuts for y in responses]


CHI2_DOCUMENTS = chi2(all_pairs("doc", ["lang", "length", "label", "source"], ["quality", "toxic", "english"]))

# --- regressions -----------------------------------------------------------

SCORING_STEPS = 11


def probit(rel: str, terms: Sequence[tuple[str, str, bool]], families: Mapping[str, Sequence[str]]) -> str:
    """CTEs ``coefs``, ``effects`` and ``fits``: unrolled Fisher scoring for all models at once.

    Linear systems are solved by sweeping the packed normal equations; the
    sandwich and the delta method are plain matrix products over long tables.
    """
    p = len(terms) + 1
    span = range(p)
    names = ["(Intercept)", *[t[0] for t in terms]]
    discrete = [i for i, t in enumerate(terms, 1) if t[2]]
    owners = [(f, d) for f, deps in families.items() for d in deps]
    pack = [(i, j) for i in span for j in range(i, p)]
    a = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    out = []

    def cte(name: str, sql: str) -> None:
        out.append(f"{name} as materialized ({sql})")

    xs = ", ".join(f"({e})::double as x{i}" for i, (_, e, _) in enumerate(terms, 1))
    cte("m", "\nunion all ".join(
        f"select {k} as model, 1.0::double as x0, {xs}, {d}::double as y from {rel} where {d} is not null"
        for k, (_, d) in enumerate(owners)))
    cte("beta0", f"select distinct model, {', '.join(f'0.0::double as b{i}' for i in span)} from m")
    eta = " + ".join(f"b{i} * x{i}" for i in span)

    def rows(step: int) -> str:
        pdf = "exp(-0.5 * eta * eta) / sqrt(2 * pi())"
        return (f"select *, pdf * pdf / (cdf * (1 - cdf)) as w, pdf * (y - cdf) / (cdf * (1 - cdf)) as u from "
                f"(select *, {pdf} as pdf, {normal_cdf('eta')} as cdf from "
                f"(select m.*, {', '.join(f'b{i}' for i in span)}, {eta} as eta from m join beta{step} using (model)))")

    def normal_equations(step: int) -> str:
        sums = [f"sum(w * x{i} * x{j}) as {a(i, j)}" for i, j in pack]
        sums += [f"sum(u * x{i}) as {a(i, p)}" for i in span]
        cte(f"n{step}", f"select model, {', '.join(sums)} from ({rows(step)}) group by model")
        last = f"n{step}"
        cells = [*pack, *[(i, p) for i in span]]
        for k in span:
            new = []
            for i, j in cells:
                if (i, j) == (k, k):
                    e = f"-1.0 / {a(k, k)}"
                elif k in (i, j):
                    e = f"{a(i, j)} / {a(k, k)}"
                else:
                    e = f"{a(i, j)} - {a(i, k)} * {a(k, j)} / {a(k, k)}"
                new.append(f"{e} as {a(i, j)}")
            cte(f"n{step}_{k}", f"select model, {', '.join(new)} from {last}")
            last = f"n{step}_{k}"
        return last

    for step in range(SCORING_STEPS):
        solved = normal_equations(step)
        cte(f"beta{step + 1}", f"select model, {', '.join(f'b{i} + {a(i, p)} as b{i}' for i in span)} "
                               f"from beta{step} join {solved} using (model)")
    inverse = normal_equations(SCORING_STEPS)

    def long(name: str, source: str, cells: Mapping[tuple[int, int], str]) -> None:
        items = ", ".join(f"{{'i': {i}, 'j': {j}, 'v': ({e})::double}}" for (i, j), e in cells.items())
        cte(name, f"select model, c.i as i, c.j as j, c.v as v from (select model, unnest([{items}]) as c from {source})")

    sums = {f"s{i}_{j}": f"sum(u * u * x{i} * x{j})" for i, j in pack}
    sums |= {"n": "count(*)", "ones": "sum(y)", "pdf": "sum(pdf)",
             "ll": "sum(case when y = 1 then ln(cdf) else ln(1 - cdf) end)"}
    sums |= {f"q{j}": f"sum(pdf * eta * x{j})" for j in span}
    for d in discrete:
        on, off = f"(eta + (1 - x{d}) * b{d})", f"(eta - x{d} * b{d})"
        sums[f"c{d}"] = f"sum({normal_cdf(on)} - {normal_cdf(off)})"
        density = lambda e: f"exp(-0.5 * {e} * {e}) / sqrt(2 * pi())"
        for j in span:
            x1, x0 = ("1", "0") if j == d else (f"x{j}", f"x{j}")
            sums[f"g{d}_{j}"] = f"sum({density(on)} * {x1} - {density(off)} * {x0})"
    cte("final", f"select model, {', '.join(f'{e} as {n}' for n, e in sums.items())} "
                 f"from ({rows(SCORING_STEPS)}) group by model")
    both = f"final join beta{SCORING_STEPS} using (model)"
    long("bread", inverse, {(i, j): f"-{a(i, j)}" for i in span for j in span})
    long("meat", "final", {(i, j): f"s{min(i, j)}_{max(i, j)}" for i in span for j in span})
    cte("robust", "select l.model, l.i, r.j, sum(l.v * k.v * r.v) as v from bread l join meat k on k.model = l.model "
                  "and k.i = l.j join bread r on r.model = l.model and r.i = k.j group by l.model, l.i, r.j")
    long("estimates", both, {(i, 0): f"b{i}" for i in span})
    long("gradient", both, {
        (i, j): f"g{i}_{j} / n" if i in discrete else f"{'pdf / n' if i == j else '0'} - b{i} * q{j} / n"
        for i in range(1, p) for j in span})
    long("change", both, {(i, 0): f"c{i} / n" if i in discrete else f"b{i} * pdf / n" for i in range(1, p)})
    cte("delta", "select l.model, l.i, sqrt(sum(l.v * k.v * r.v)) as se from gradient l join robust k "
                 "on k.model = l.model and k.i = l.j join gradient r on r.model = l.model and r.i = l.i and r.j = k.j "
                 "group by l.model, l.i")
    owner_rows = ", ".join(f"({k}, '{f}', '{d}')" for k, (f, d) in enumerate(owners))
    out.append(f"owners(model, family, dep) as (values {owner_rows})")
    term_rows = ", ".join(f"({i}, '{n}', '{'discrete' if i in discrete else 'continuous'}')" for i, n in enumerate(names))
    out.append(f"term_names(i, term, kind) as (values {term_rows})")
    two_sided = f"2 * (1 - {normal_cdf('least(abs(z), 8)', 160)})"
    out.append(f"""coefs as (select *, {two_sided} as p_value from (
      select family, dep, model as dep_ord, term, e.i as term_ord, e.v as estimate, sqrt(b.v) as std_error,
             sqrt(v.v) as std_error_robust, e.v / sqrt(b.v) as z
      from estimates e join owners using (model) join term_names using (i)
      join bread b on b.model = e.model and b.i = e.i and b.j = e.i
      join robust v on v.model = e.model and v.i = e.i and v.j = e.i))""")
    out.append(f"""effects as (select *, {two_sided} as p_value from (
      select family, dep, model as dep_ord, term, c.i as term_ord, kind, c.v as dydx, se, c.v / se as z
      from change c join owners using (model) join term_names using (i) join delta using (model, i)))""")
    out.append(f"""fits as (
      select family, dep, model as dep_ord, n, ones, ll, -2 * ll as deviance,
             -2 * (ones * ln(ones / n) + (n - ones) * ln(1 - ones / n)) as null_deviance,
             -2 * ll + 2 * {p} as aic, -2 * ll + {p} * ln(n) as bic
      from final join owners using (model))""")
    return ",\n".join(out)


COEFFICIENTS = f"""select family, dep, dep_ord, term, term_ord, {r('estimate')} as estimate, {r('std_error')} as std_error,
  {r('std_error_robust')} as std_error_robust, {r('z')} as z, {r('p_value')} as p_value, 'ok' as status from coefs"""
EFFECTS = f"""select family, dep, dep_ord, term, term_ord, kind, {r('dydx')} as dydx, {r('se')} as std_error_robust,
  {r('z')} as z, {r('p_value')} as p_value, 'ok' as status from effects"""
FITS = f"""select family, dep, dep_ord, n, ones::bigint as ones, {r('ll')} as loglik, {r('deviance')} as deviance,
  {r('null_deviance')} as null_deviance, {r('aic')} as aic, {r('bic')} as bic, 'ok' as status from fits"""
SIGNS = "select dep as depvar, dep_ord, " + ", ".join(
    f"max(case when p_value <= 0.05 then case when estimate > 0 then '(+)' else '(-)' end else ' ' end) "
    f"filter (term = '{t}') as \"{t}\"" for t in list(survey.COEFFICIENT_LABELS)[1:]) + " from coefs group by dep, dep_ord"


def report(family: str) -> str:
    deps = survey.PROBIT_FAMILIES[family]
    star = ("case when p_value < 0.01 then '***' when p_value < 0.05 then '**' when p_value < 0.1 then '*' else '' end")
    cell = f"printf('%.4f', estimate) || {star} || ' (' || printf('%.4f', std_error) || ')'"
    label = "case term " + " ".join(f"when '{t}' then '{l}'" for t, l in survey.COEFFICIENT_LABELS.items()) + " end"
    lines = [f"select {label} as term, term_ord as row_ord, dep, {cell} as cell from coefs"]
    for i, (name, c) in enumerate((("AIC", "aic"), ("BIC", "bic"), ("Log Likelihood", "ll"), ("Deviance", "deviance"))):
        lines.append(f"select '{name}', {100 + i}, dep, printf('%.4f', {c}) from fits")
    lines.append("select 'Num. obs.', 104, dep, cast(n as varchar) from fits")
    columns = ", ".join(f"max(cell) filter (dep = '{d}') as {d}" for d in deps)
    return f"select term, row_ord, {columns} from ({' union all '.join(lines)}) group by term, row_ord"


DOCUMENT_MODELS = probit(
    "doc", [("langde", "lang = 'de'", True), ("langes", "lang = 'es'", True), ("langfr", "lang = 'fr'", True),
            ("kchars", "n_chars / 1000.0::double", False)], {"labels": ["quality", "toxic"]})
LISTED_MODELS = probit(
    "listed", [("langde", "lang = 'de'", True), ("langfr", "lang = 'fr'", True),
               ("kchars", "n_chars / 1000.0::double", False)], {"labels": ["quality", "toxic"]})
LINE_MODELS = probit(
    "li", [("l_quantity", "l_quantity", False), ("l_discount", "l_discount", False),
           ("l_linestatusO", "l_linestatus = 'O'", True)], {"lines": ["returned", "untaxed"]})

# --- the survey ------------------------------------------------------------

_YES = list(survey.YES_FLAGS)
_RISK = list(survey.RISK_FLAGS)
_BOXES = list(survey.ANSWERED_FLAGS.values())


def bit(mask: str, position: int) -> str:
    return f"(coalesce({mask}, 0) >> {position}) & 1 = 1"


def yes_flag(slot: int) -> str:
    return f"case when {bit('yes', slot)} then 1 when {bit('asked', slot)} then 0 end"


def _panel() -> str:
    from canvass.sources import schema

    uses = "case when t = 8 then 8 when p <= 2 then 0 when p <= 4 then 1 else p - 3 end"
    channel = ("case when dom >= 29 then 6 when dom >= 26 then 5 when dom >= 23 then 4 when dom >= 20 then 3 "
               "when dom >= 17 then 2 when dom >= 13 then 1 else 0 end")
    picked = lambda test, v: f"sum(case when q is null then null when {test} then {v} else 0 end)"
    mask = lambda test, pos: f"bit_or(case when {test} then 1::bigint << {pos} else 0 end)"
    answers = [
        *[f"{mask(t, 'slot')} as {n}" for n, t in (("asked", "q is not null"), ("yes", "rf = 'R'"), ("no", "rf = 'N'"))],
        *[f"{mask(t, 'q::int')} as {n}" for n, t in (("seen", "q is not null"), ("ticked", "ls = 'F'"))],
        "sum(q) as acres", "sum(cents) as cents",
        *[f"{picked(f'use = {i}', 'q')} as use{i}" for i in range(9)],
        *[f"{picked(f'channel = {i}', 'cents')} as channel{i}" for i in range(7)],
        *[f"{picked(f'rf = {chr(39)}R{chr(39)} and t = {i}', 'q')} as lost{i}" for i in range(3)],
        "arg_max(o_orderpriority, o_orderkey) as last_priority",
        "arg_min(o_orderpriority, o_orderkey) as first_priority",
        "cast(arg_max(year(o_orderdate), o_orderkey) as varchar) as last_year",
        "arg_max(o_orderstatus, o_orderkey) || arg_min(o_orderstatus, o_orderkey) as statuses",
    ]
    held = "(greatest(c_acctbal, 0) / 10000.0::double)"
    square = lambda e: f"({e}) * ({e})"
    weight = f"({square(held)})"
    boxes = {c: i % 50 + 1 for i, c in enumerate(schema.CHECK_ALL)}
    slots = {c: i for i, c in enumerate((*schema.YES_NO, *schema.RISK))}
    answered = lambda c: bit("ticked", boxes[c])
    owing = "c_acctbal < 0"
    five = {2: "Most", 5: "Some", 3: "None"}
    priorities = ["", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    landscape = lambda c: f"case when {owing} then null " + " ".join(
        f"when {c} = '{priorities[k - 1]}' then '{v}'" for k, v in five.items()) + " end"
    share = lambda e: f"({e})::double / nullif(acres, 0)"
    uses9 = ["acre_infield_veg_herb", "acre_infield_fruit", "acre_infield_cerealbeans", "acre_gh", "acre_pasture",
             "acre_grass", "acre_wild", "acre_fallow", "acre_other"]
    other = "case when c_acctbal >= 0 then use8 end"
    use_of = {c: (other if c == "acre_other" else f"use{i}") for i, c in enumerate(uses9)}
    channels = [f"case when c_acctbal < 9500 then 100.0::double * channel{i} / nullif(cents, 0) end" for i in range(7)]
    first = {
        "c_custkey": "c_custkey",
        "region_epa": f"case when {owing} then null else r_name end",
        "rev_est": f"nullif(cents / 100.0::double * {weight}, 0)",
        "exp_est": f"nullif(channel0 / 100.0::double * {weight}, 0)",
        "org": f"case when {owing} then null when c_mktsegment = 'AUTOMOBILE' then 'Both' "
               "when c_mktsegment = 'BUILDING' then 'Organic' when c_mktsegment = 'FURNITURE' then 'Conventional' end",
        "lscape_wild": landscape("last_priority"),
        "lscape_graze": landscape("first_priority"),
        "test_freq": f"case when {owing} then null when last_year in ('1995', '1998') then 'freq' "
                     "when last_year in ('1999', '2001') then 'occ' when last_year = '1997' then 'never' end",
        "treat_freq": f"case when {owing} then null when statuses = 'FF' then 'never' "
                      "when statuses = 'FP' then 'always' when statuses = 'OF' then 'sometimes' end",
        "fvacreage_pct": share("use0 + use1"),
        **{name: share(use_of[c]) for name, c in survey.SHARES.items()},
        "sale_directcons": channels[0],
        "dist_hhi": " + ".join(square(c) for c in channels),
        **{name: yes_flag(slots[c]) for name, c in {**survey.YES_FLAGS, **survey.RISK_FLAGS}.items()},
        **{name: f"cast({answered(c)} as int)" for name, c in survey.ANSWERED_FLAGS.items()},
        **{name: f"cast({answered(a)} or {answered(b)} as int)" for name, (a, b) in survey.ANY_ANSWERED_FLAGS.items()},
        "acre_rej": "cast(coalesce(nullif(lost0, 7) > 0, false) or coalesce(nullif(lost1, 7) > 0, false) "
                    "or coalesce(nullif(lost2, 7) > 0, false) as int)",
        "fs_ins_payout": f"cast({bit('yes', 40)} and coalesce(lost1, 0) > 0 as int)",
        "fs_oth_comp": f"cast(not {bit('no', 41)} and {bit('yes', 41)} and coalesce(lost2, 0) > 0 as int)",
        "pna_known": bit("asked", 44),
        "pna_used": bit("yes", 44),
    }
    second = {
        "rev_cat": bins("rev_est", *REVENUE_BINS),
        "rev_cat_abbr": "case when rev_est < 25000 then '<25K' when rev_est < 500000 then '25-500K' "
                        "when rev_est is not null then '>500K' end",
        "org_abbr": "case when org in ('Both', 'Organic') then 'Some' when org = 'Conventional' then 'None' end",
        "fvacreage_quartile": bins("fvacreage_pct", (0.25, 0.5, 0.75), survey.QUARTILE.levels),
        "directsales_quartile": bins("sale_directcons", (25, 50, 75), survey.QUARTILE.levels),
        "acre_hhi": " + ".join(square(f"{n} * 100") for n in survey.SHARES),
        "surface": "greatest(water_touch_stand, water_touch_flow)",
        **{n: f"greatest({', '.join(cs)})" for n, cs in survey.ROW_MAX_FLAGS.items()},
        **{n: f"least({', '.join(cs)})" for n, cs in survey.ROW_MIN_FLAGS.items()},
    }
    third = {
        "surface_nt": "cast(surface = 0 and greatest(water_any_stand, water_any_flow) = 1 as int)",
        "nosurface_any": "cast(surface = 0 and pna_known as int)",
        "nosurface": "cast(surface = 0 and pna_known and greatest(water_any_stand, water_any_flow) = 0 as int)",
    }
    cols = lambda d: ", ".join(f"{e} as {n}" for n, e in d.items())
    return f"""
parts as (
  select l_orderkey, l_returnflag as rf, l_linestatus as ls, cast(l_quantity as bigint) as q,
         cast(round(l_discount * 100) as int) as p, cast(round(l_tax * 100) as int) as t,
         cast(round(l_extendedprice * 100) as bigint) as cents, day(l_shipdate) as dom from lineitem),
coded as (select *, t * 5 + least(p // 2, 4) as slot, {uses} as use, {channel} as channel from parts),
answers as (select o_custkey, {", ".join(answers)}
  from orders left join coded on l_orderkey = o_orderkey group by o_custkey),
base as (select * from customer left join answers on o_custkey = c_custkey
  left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey),
first_ as (select {cols(first)} from base),
second_ as (select *, {cols(second)} from first_),
d as materialized (select *, {cols(third)} from second_)"""


PANEL = _panel()
CUT_LABELS = survey.CUT_LABELS


def survey_models(*families: str) -> str:
    """The panel's complete rows and the models of the families."""
    terms = [
        ("org_abbrSome", "org_abbr = 'Some'", True),
        ("rev_cat_abbr25-500K", "rev_cat_abbr = '25-500K'", True),
        ("rev_cat_abbr>500K", "rev_cat_abbr = '>500K'", True),
        ("fvacreage_pct", "fvacreage_pct * 100", False),
        ("sale_directcons", "sale_directcons", False),
        ("lscape_wildMost", "lscape_wild = 'Most'", True),
        ("lscape_wildSome", "lscape_wild = 'Some'", True),
    ]
    keep = " and ".join(f"{c} is not null" for c in (
        "org_abbr", "rev_cat_abbr", "fvacreage_pct", "lscape_wild", "region_epa", "sale_directcons"))
    return (f"with {PANEL},\ncomplete as materialized (select * from d where {keep}),\n"
            + probit("complete", terms, {f: survey.PROBIT_FAMILIES[f] for f in families or survey.PROBIT_FAMILIES}))


def profile_table(name: str) -> str:
    cuts, columns = survey.PROFILE_TABLES[name]
    return profile("d", [(c, CUT_LABELS[c]) for c in cuts],
                   {("none" if c == "noone" else c): avg(c) for c in columns}, "All Farms")


def farm_characteristics() -> str:
    """Ten blocks; each cell is a filtered aggregate of the block's rows."""
    names = [*survey.REVENUE.levels, "NA"]
    where = {n: f"rev_cat = '{n}'" for n in survey.REVENUE.levels} | {"NA": "rev_cat is null"}

    def block(kind: str, level: str, value: str, empty: str, group: str) -> str:
        cells = {n: f"case when count(*) filter ({w}) = 0 then 0 else coalesce({value} filter ({w}), {empty}) end"
                 for n, w in where.items()}
        plus = " + ".join(f"({c})" for c in cells.values())
        shown = ", ".join(f'{r(f"({c})::double")} as "{n}"' for n, c in cells.items())
        return (f"select '{kind}' as type, {level} as level, {shown}, "
                f'{r(f"coalesce({value}, {empty})::double")} as "all", {r(f"({plus})::double")} as row_sum '
                f"from d {group}")

    nan = "'NaN'::double"
    blocks = [block("All Farms", "'All'", "count(*)", "0", "")]
    blocks += [block(k, c, "count(*)", "0", f"group by {c}") for k, c in (
        ("Organic Status", "org"), ("Region", "region_epa"),
        ("Landscape Wildlife Habitat", "lscape_wild"), ("Landscape Grazing Land", "lscape_graze"))]
    blocks += [block(k, "'All'", f"avg({c})", nan, "") for k, c in (
        ("Prop. FV Acreage", "fvacreage_pct"), ("Avg. Acreage HHI", "acre_hhi"), ("Avg. Distribution HHI", "dist_hhi"))]
    blocks += [block(k, "'All'", f"sum({c})", "0", "") for k, c in (
        ("Surface Water", "surface"), ("Other Water", "nosurface_any"))]
    assert len(names) == 7
    return "\nunion all ".join(blocks)


def water_management() -> str:
    rows = []
    for m in ("surface", "surface_nt", "nosurface"):
        cells = [f'coalesce(sum({m}), 0)::bigint as "All Farms_All"']
        for c, domain in (("test_freq", survey.TEST_FREQ), ("treat_freq", survey.TREAT_FREQ)):
            for v in (*domain.levels, None):
                test = f"{c} is null" if v is None else f"{c} = '{v}'"
                cells.append(f'(case when count(*) filter ({test}) > 0 then coalesce(sum({m}) filter ({test}), 0) end)'
                             f'::bigint as "{CUT_LABELS[c]}_{v or "NA"}"')
        rows.append(f"select '{m}' as var, {', '.join(cells)} from d")
    return "\nunion all ".join(rows)


def derived_columns() -> str:
    names = [
        "rev_est", "exp_est", "rev_cat", "rev_cat_abbr", "org", "org_abbr", "fvacreage_pct", *survey.SHARES,
        "fvacreage_quartile", "acre_hhi", "dist_hhi", "directsales_quartile", "lscape_wild", "lscape_graze",
        *survey.YES_FLAGS, *survey.RISK_FLAGS, *survey.ANSWERED_FLAGS, *survey.ANY_ANSWERED_FLAGS,
        "acre_rej", "fs_ins_payout", "fs_oth_comp", "test_freq", "treat_freq",
        *survey.ROW_MAX_FLAGS, *survey.ROW_MIN_FLAGS]
    return f"select c_custkey, region_epa, {', '.join(names)} from d"


def survey_scan() -> str:
    missing = {
        "state": "not owing and n_name is null", "org_v_conv": "not owing and c_mktsegment is null",
        "other_pna": f"not {bit('asked', 44)}", "train_attend": f"not {bit('asked', 0)}",
        "risk_birds": f"not {bit('asked', 25)}", "water_stand": f"not {bit('seen', 9)}",
        "rev_est": "cents is null", "acre_other": "owing or use8 is null",
        "sale_directcons": "c_acctbal >= 9500 or coalesce(cents, 0) = 0",
        "loss_acre_animals": "coalesce(lost0, 7) = 7",
    }
    silent = lambda k: f"{bit('asked', k)} and not {bit('yes', k)} and not {bit('no', k)}"
    blank = {
        "state": "owing", "org_v_conv": "owing", "other_pna": silent(44), "train_attend": silent(0),
        "risk_birds": silent(25), "water_stand": f"{bit('seen', 9)} and not {bit('ticked', 9)}",
    }
    shown = [f"count(*) filter ({e}) as {n}_missing" for n, e in missing.items()]
    shown += [f"count(*) filter ({e}) as {n}_blank" for n, e in blank.items()]
    return (f"select count(*) as n, {', '.join(shown)}, sum(acres)::double as acres "
            "from (select *, c_acctbal < 0 as owing from base)")


SURVEY_CHI2 = chi2([("d", x, y) for cuts, responses in survey.CHI2_FAMILIES for x in cuts for y in responses])


def manifest(tables: Mapping[str, tuple[str, int]]) -> str:
    return "\nunion all ".join(
        f"select '{n}' as name, count(*) as \"rows\", {cols} as cols from ({sql})" for n, (sql, cols) in tables.items())


def contents(tables: Mapping[str, str]) -> str:
    """All rows of several tables, columns matched by name."""
    return "\nunion all by name ".join(f"select '{n}' as name, * from ({sql})" for n, sql in tables.items())


WORKBOOK = contents({
    "tbl1": farm_characteristics(), **{n: profile_table(n) for n in survey.PROFILE_TABLES}, "tblA1": water_management()})


def table_order(name: str) -> str:
    """Blocks as listed, levels by their domain, missing ones last."""
    cuts, _ = survey.PROFILE_TABLES[name]
    levels = {c.column: c.domain.levels for c in survey._cuts(panel.DICTIONARY, cuts)}
    blocks = ["select 'All Farms' as type, 'All' as level, 0 as b, 0 as l"]
    for i, c in enumerate(cuts, 1):
        order = " ".join(f"when '{v}' then {k}" for k, v in enumerate(levels[c]))
        blocks.append(f"select '{CUT_LABELS[c]}', {c}, {i}, case {c} {order} else 99 end from d group by {c}")
    return f"select type, level, row_number() over (order by b, l)::int as place from ({' union all '.join(blocks)})"


ORACLE: dict[str, str] = {
    "profile_segments": f"with {CUSTOMERS}\n{PROFILE_SEGMENTS}",
    "profile_flags_nullable": f"with {DOCUMENTS}\n{PROFILE_DOCUMENTS}",
    "profile_open_cuts": f"with {DOCUMENTS}\n" + profile(
        "doc", [("source", "Source"), ("lang", "Language")],
        {"quality": avg("quality"), "toxic": avg("toxic")}, "All documents"),
    "global_summary": f"""with {DOCUMENTS}
        select count(*) as "N", {avg('quality')} as quality, {avg('toxic')} as toxic,
               {total('toxic')} as toxic_docs from doc""",
    "conditional_count": "select count(*) as urgent from orders where o_orderpriority = '1-URGENT'",
    "frequency_table": f"with {DOCUMENTS} select label, count(*) as freq from doc where label is not null group by label",
    "group_frequency": f"with {DOCUMENTS} select label, count(*) as freq from doc group by label",
    "mean_interval": interval("lineitem", "l_discount", 9),
    "crosstab_counts": CROSSTAB_COUNTS,
    "crosstab_unlisted": """
        with o as (select source as level, case lang when 'fr' then 'NA' when 'es' then null else lang end as p from documents)
        select 'Source' as type, level, count(*) filter (p = 'en') as en, count(*) filter (p is null) as "NA",
          count(*) filter (p in ('de', 'NA')) as other, count(*) as "all" from o group by level""",
    "crosstab_means_nan": f"with {DOCUMENTS}\nselect 'Source' as type, source as level, " + ", ".join(
        "case when count(*) filter ({0}) = 0 then 0.0::double else coalesce({1}, 'NaN'::double) end as \"{2}\"".format(
            test, r(f"avg(toxic) filter ({test})"), name)
        for name, test in (*[(v, f"lang = '{v}'") for v in ("de", "en", "es", "fr")], ("NA", "lang is null"),
                             ("other", "lang not in ('de', 'en', 'es', 'fr')"))
    ) + " from doc group by source",
    "transpose_table": f"with {LINES},\n" + """c as (select *, discounted as off, (1 - discounted) * untaxed as free,
        (1 - discounted) * (1 - untaxed) as plain from li)\n""" + "\nunion all ".join(
        f"select '{m}' as var, sum({m})::bigint as \"All_All\", "
        + ", ".join(f"(sum({m}) filter ({c} = '{v}'))::bigint as \"{k}_{v}\"" for k, c, vs in (
            ("Flag", "l_returnflag", "ANR"), ("Status", "l_linestatus", "FO")) for v in vs)
        + " from c" for m in ("off", "free", "plain")),
    "gather_measures": f"with {DOCUMENTS}\n" + " union all ".join(
        f"select doc_id, '{c}' as var, {c} as value from doc" for c in ("quality", "toxic", "english")),
    "union_by_name_fill": """
        select c_name as name, c_nationkey::bigint as place, c_acctbal as balance, c_mktsegment as segment from customer
        union all by name select s_acctbal as balance, s_name as name, s_nationkey as place from supplier""",
    "bin_thresholds": """
        with b as (select case when c_acctbal <= 0 then null when c_acctbal < 1000 then '<1K' when c_acctbal < 4000
          then '1-4K' when c_acctbal < 8000 then '4-8K' else '8K+' end as bin from customer)
        select bin, count(*) as n, case bin when '<1K' then 1 when '1-4K' then 2 when '4-8K' then 3 when '8K+' then 4 end
          as bin_ord from b group by bin""",
    "recode_collapse": """
        with pos as (select p, row_number() over (order by p) as k from
          (select distinct o_orderpriority as p from orders where o_orderpriority is not null))
        select case when k in (1, 2) then 'fast' when k in (3, 5) then 'calm' end as pace, count(*) as n
        from orders left join pos on p = o_orderpriority group by 1""",
    "domain_restrict": """
        select case when c_mktsegment in ('MACHINERY', 'BUILDING', 'FURNITURE') then c_mktsegment end as segment,
          case c_mktsegment when 'MACHINERY' then 1 when 'BUILDING' then 2 when 'FURNITURE' then 3 end as segment_ord,
          count(*) as n from customer group by 1, 2""",
    "share_concentration": f"""
        with long as (select o_custkey, o_orderpriority as p, sum(cast(round(o_totalprice * 100) as bigint))::double as s
          from orders group by all),
        h as (select o_custkey, sum(pow(100 * s / t, 2)) as hhi,
                coalesce(sum(s / t) filter (p = '1-URGENT'), 0.0) as share0
              from (select *, nullif(sum(s) over (partition by o_custkey), 0) as t from long) group by o_custkey)
        select c_custkey, {r('share0', 4)} as share0, {r('hhi', 4)} as hhi
        from customer left join h on o_custkey = c_custkey""",
    "answered_flags": f"""
        with e as (select *, event_type in ('click', 'purchase', 'signup') and coalesce(props, '') <> '' as a,
                     event_type = 'error' as y from events)
        select event_type, count(*) as n, sum(a::int)::bigint as answered, sum((a or y)::int)::bigint as any_answered,
          {r("avg(case when event_type = 'click' then null else y::int end)")} as yes,
          count(*) filter (event_type <> 'click') as yes_known,
          sum((coalesce(value - 50 > 0, false) or (y and coalesce(value > 0, false)))::int)::bigint as positive
        from e group by event_type""",
    "coerce_positive": """
        select c_mktsegment, sum((c_mktsegment not in ('MACHINERY', 'FURNITURE') and floor(c_acctbal) > 0)::int)::bigint
          as paid, count(*) as n from customer group by c_mktsegment""",
    "row_extremes": f"""with {DOCUMENTS}
        select doc_id, case when quality + toxic + english is not null then greatest(quality, toxic, english) end as most,
          case when quality + toxic + english is not null then least(quality, toxic, english) end as least,
          quality + toxic + english as total from doc""",
    "boolean_columns": f"""with {DOCUMENTS}
        select doc_id, lang, (quality = 1)::int as good, (quality = 1 and not (toxic = 1))::int as clean,
          (quality = 1 or toxic = 1)::int as either, (quality is null)::int as unlabelled from doc""",
    "select_and_rename": f"""
        select p_type as kind, p_brand as brand, p_partkey as partkey, p_name as name, p_size as size,
          {r('p_retailprice / 100')} as retailprice from part""",
    "natural_join_map": """
        with s(n_regionkey, side) as (values (0, 'South'), (1, 'West'), (3, 'North'))
        select side, count(*) as n from customer left join nation on n_nationkey = c_nationkey
        left join s using (n_regionkey) group by side""",
    "left_join_keep_unmatched": "select d.doc_id, quality, toxic from documents d left join labels l on l.doc_id = d.doc_id",
    "full_outer_region_freq": f"""with {CUSTOMERS},
        f as (select r_name, count(*) as freq from cus where r_name <> 'EUROPE' group by r_name),
        a as (select r_name as name, 'POINT(' || r_regionkey || ' 0)' as geometry_wkt from region where r_name <> 'AFRICA')
        select coalesce(a.name, f.r_name) as name, geometry_wkt, freq, {r('sqrt(freq)')} as sqrt_freq
        from a full join f on f.r_name = a.name""",
    "listwise_complete": f"with {DOCUMENTS} select doc_id, quality, toxic from doc where quality is not null and toxic is not null",
    "chi2_by_flag": f"with {LINES}, {CUSTOMERS}, " + chi2(
        all_pairs("li", ["l_returnflag"], ["discounted", "untaxed", "large"])
        + all_pairs("cus", ["c_mktsegment", "r_name"], ["in_credit", "wealthy"])),
    "chi2_two_by_two": f"with {LINES}, " + chi2(
        all_pairs("li", ["l_linestatus"], ["discounted", "untaxed", "large", "returned"])),
    "chi2_nullable": f"with {DOCUMENTS}, {CHI2_DOCUMENTS}",
    "chi2_large": """with li as (select l_partkey % 61 as part, l_orderkey % 53 as ord from lineitem),
        """ + chi2([("li", "part", "ord")]),
    "chi2_categories": "with " + chi2([("orders", "o_orderstatus", "o_orderpriority")]),
    "chi2_sparse": f"with {DOCUMENTS}, " + chi2([("doc", "source", "length")]),
    "design_matrix": f"""with {DOCUMENTS}
        select doc_id, quality, (lang = 'de')::int::double as langde, (lang = 'es')::int::double as langes,
          (lang = 'fr')::int::double as langfr, {r('n_chars / 1000.0::double')} as kchars
        from doc where quality is not null and toxic is not null""",
    "csv_round_trip": f"with {DOCUMENTS}\n{PROFILE_DOCUMENTS}",
    "quoted_csv_round_trip": f"with {DOCUMENTS}, {CHI2_DOCUMENTS}",
    "region_attributes_scan": "select r_name as name, 'POINT(' || r_regionkey || ' 0)' as geometry_wkt from region",
    "region_map_csv": """select r_name as region_epa, cast(n_nationkey as varchar) as state_abb
        from nation join region on n_regionkey = r_regionkey""",
    "bundle_counts": f"with {CUSTOMERS}, {DOCUMENTS}\n" + manifest({
        "segments": (PROFILE_SEGMENTS, 8), "documents": (PROFILE_DOCUMENTS, 7),
        "orders": ("select distinct o_orderstatus from orders", 9)}),
    "bundle_round_trip": f"with {CUSTOMERS}, {DOCUMENTS}\n" + contents({
        "segments": PROFILE_SEGMENTS, "documents": PROFILE_DOCUMENTS, "orders": CROSSTAB_COUNTS}),
    "derived_columns": f"with {PANEL}\n{derived_columns()}",
    "survey_csv_scan": f"with {PANEL}\n{survey_scan()}",
    "tbl1": f"with {PANEL}\n{farm_characteristics()}",
    "tbl1_checks": f"""with {PANEL}
        select {r('avg(dist_hhi)')} as dist_hhi, {r('avg(acre_hhi)')} as acre_hhi,
          {r('avg(fvacreage_pct)')} as fvacreage_pct,
          count(*) filter (pna_used) as other_pna_used from d""",
    **{name: f"with {PANEL}\n{profile_table(name)}" for name in survey.PROFILE_TABLES},
    "tblA1": f"with {PANEL}\n{water_management()}",
    "workbook": f"with {PANEL}\n{WORKBOOK}",
    "independence_tests": f"with {PANEL}, {SURVEY_CHI2}",
    "acreage_interval": f"with {PANEL}\n{interval('d', 'fvacreage_pct', 9)}",
    "region_map": f"""with {PANEL},
        f as (select region_epa, count(*) as freq from d where region_epa is not null group by region_epa)
        select coalesce(r_name, region_epa) as name, 'POINT(' || r_regionkey || ' 0)' as geometry_wkt, freq,
          {r('sqrt(freq)')} as sqrt_freq from region full join f on region_epa = r_name""",
    "mean_interval_by": f"with recursive {DOCUMENTS}, {interval_by('doc', 'quality', 'source', 0.95, 6)}",
    "probit_documents": f"with {DOCUMENTS},\n{DOCUMENT_MODELS}\n{COEFFICIENTS}",
    "probit_lines": f"with {LINES},\n{LINE_MODELS}\n{EFFECTS}",
    "probit_coefficients": f"{survey_models()}\n{COEFFICIENTS}",
    "probit_effects": f"{survey_models()}\n{EFFECTS}",
    "probit_fits": f"{survey_models()}\n{FITS}",
    "probit_signs": f"{survey_models()}\n{SIGNS}",
    "tblA3": f"{survey_models('fs')}\n{report('fs')}",
    "tblA4": f"{survey_models('buf')}\n{report('buf')}",
    "tblA5": f"{survey_models('hab')}\n{report('hab')}",
    "tblA6": f"{survey_models('det')}\n{report('det')}",
    "tblA7": f"{survey_models('con')}\n{report('con')}",
    "model_bundle": f"""{survey_models()},
        c as ({COEFFICIENTS}), e as ({EFFECTS}), f as ({FITS})
        select 'coefficients' as stored_as, * from c union all by name select 'effects' as stored_as, * from e
        union all by name select 'fits' as stored_as, * from f""",
    "report_bundle": f"{survey_models()}\n" + "\nunion all by name ".join(
        f"select '{f}' as family, * exclude (row_ord) from ({report(f)})" for f in survey.PROBIT_FAMILIES),
    "probit_far_from_zero": f"with {LINES},\n{LINE_MODELS}\n{EFFECTS}",
    "probit_undeclared_level": f"with {DOCUMENTS},\nlisted as (select * from doc where lang in ('en', 'de', 'fr')),\n{LISTED_MODELS}\n{COEFFICIENTS}",
    "tbl2_order": f"with {PANEL}\n{table_order('tbl2')}",
    "tbl2_from_data": f"with {PANEL}\n{profile_table('tbl2')}",
}
