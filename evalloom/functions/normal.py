"""Normal distribution as column expressions, and the same expressions as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational forms of the normal quantile (Wichura 1988, AS 241), centre, middle and tail, highest power last.
CENTRE = (
    [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
)
MIDDLE = (
    [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
)
TAIL = (
    [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
)
# Upper tail of the normal distribution (Hart 1968), highest power last; beyond FAR a continued fraction.
UPPER = (
    [220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 0.0352624965998911],
    [440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 0.0883883476483184],
)
FAR, ROOT_2PI = 7.07106781186547, 2.506628274631000502


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def polynomial(coefficients: list[float], x: Column) -> Column:
    """Name ``x`` by ``once`` unless it is a column: it stands here once a power."""
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def ratio(form: tuple[list[float], list[float]], x: Column) -> Column:
    return polynomial(form[0], x) / polynomial(form[1], x)


def quantile(p: Column) -> Column:
    """The standard normal quantile; null outside of the open interval from 0 to 1."""
    outer = lambda r: F.when(r <= 5.0, once(r - 1.6, lambda x: ratio(MIDDLE, x))).otherwise(once(r - 5.0, lambda x: ratio(TAIL, x)))
    edge = lambda v: F.signum(v - 0.5) * once(F.sqrt(-F.log(F.least(v, 1.0 - v))), outer)
    inner = lambda q: q * once(0.180625 - q * q, lambda x: ratio(CENTRE, x))
    return once(p, lambda v: F.when((v > 0) & (v < 1), F.when(F.abs(v - 0.5) <= 0.425, once(v - 0.5, inner)).otherwise(edge(v))))


def upper_tail(z: Column) -> Column:
    """The chance that a standard normal value exceeds ``z``."""
    def tail(a: Column) -> Column:
        far = a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))
        return F.exp(-a * a / 2.0) * F.when(a < FAR, ratio(UPPER, a)).otherwise(1.0 / far / ROOT_2PI)

    return once(z, lambda v: once(F.abs(v), lambda a: F.when(v >= 0, tail(a)).otherwise(1.0 - tail(a))))


def polynomial_sql(coefficients: list[float], x: str) -> str:
    out = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * ({x}) + {c!r})"
    return f"CAST({out} AS DOUBLE)"


def quantile_sql(p: str) -> str:
    """``quantile`` as SQL text."""
    q, r = f"(({p}) - 0.5)", f"sqrt(-ln(least({p}, 1.0 - ({p}))))"
    ratio_sql = lambda form, x: f"{polynomial_sql(form[0], x)} / {polynomial_sql(form[1], x)}"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio_sql(CENTRE, f'0.180625 - {q} * {q}')} WHEN {r} <= 5.0 THEN sign({q}) * {ratio_sql(MIDDLE, f'{r} - 1.6')} ELSE sign({q}) * {ratio_sql(TAIL, f'{r} - 5.0')} END"


def upper_tail_sql(z: str) -> str:
    """``upper_tail`` within ``FAR`` as SQL text."""
    tail = f"exp(-abs({z}) * abs({z}) / 2.0) * {polynomial_sql(UPPER[0], f'abs({z})')} / {polynomial_sql(UPPER[1], f'abs({z})')}"
    return f"CASE WHEN ({z}) >= 0 THEN {tail} ELSE 1.0 - {tail} END"
