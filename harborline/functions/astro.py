"""Tidal astronomy as native expressions: mean longitudes, node factors, constituents, basis columns.

Everything is a chain of projections over one column `us` (microseconds since 1970 UTC), evaluated inside whole-stage code; no
row leaves the JVM. References: Meeus, Astronomical Algorithms; Schureman, Special Publication 98.
"""

from __future__ import annotations

from dataclasses import dataclass

from harborline.plans.steps import Steps, mod360, number, wrap180

# Polynomials in Julian centuries from J2000, degrees.
MOON = (218.3164591, 481267.88134236, -0.0013268, 1 / 538841.0 - 1 / 65194000.0)
SUN = (280.46645, 36000.76983, 0.0003032)
LUNAR_PERIGEE = (83.3532430, 4069.0137111, -0.0103238, -1 / 80053.0 + 1 / 18999000.0)
LUNAR_NODE = (125.0445550, -1934.1361849, 0.0020762, 1 / 467410.0 - 1 / 60616000.0)
SOLAR_PERIGEE = (-77.06265, 1.71902, 0.0004591, 0.00000048)
#: Obliquity in units of 10000 Julian years: 23°26'21.448" and arc seconds.
OBLIQUITY_SECONDS = (84381.448, -4680.93, -1.55, 1999.25, -51.38, -249.67, -39.05, 7.12, 27.87, 5.79, 2.45)
LUNAR_INCLINATION = 5.145
J2000, UNIX_EPOCH_JD = 2451545.0, 2440587.5


@dataclass(frozen=True)
class Constituent:
    name: str
    doodson: tuple[int, ...]  # of tau, s, h, p, N', p1
    phase0: float
    species: str
    family: str  # of node factors
    power: int = 1


# The catalogue.
CATALOG = [
    Constituent("M2", (2, 0, 0, 0, 0, 0), 0.0, "semidiurnal", "m2"),
    Constituent("S2", (2, 2, -2, 0, 0, 0), 0.0, "semidiurnal", "unity"),
    Constituent("N2", (2, -1, 0, 1, 0, 0), 0.0, "semidiurnal", "m2"),
    Constituent("K2", (2, 2, 0, 0, 0, 0), 0.0, "semidiurnal", "k2"),
    Constituent("K1", (1, 1, 0, 0, 0, 0), -90.0, "diurnal", "k1"),
    Constituent("O1", (1, -1, 0, 0, 0, 0), 90.0, "diurnal", "o1"),
    Constituent("P1", (1, 1, -2, 0, 0, 0), 90.0, "diurnal", "unity"),
    Constituent("Q1", (1, -2, 0, 1, 0, 0), 90.0, "diurnal", "o1"),
    Constituent("M4", (4, 0, 0, 0, 0, 0), 0.0, "shallow", "m2", 2),
    Constituent("MS4", (4, 2, -2, 0, 0, 0), 0.0, "shallow", "m2"),
    Constituent("MN4", (4, -1, 0, 1, 0, 0), 0.0, "shallow", "m2", 2),
    Constituent("M6", (6, 0, 0, 0, 0, 0), 0.0, "shallow", "m2", 3),
    Constituent("S4", (4, 4, -4, 0, 0, 0), 0.0, "shallow", "unity"),
    Constituent("Mf", (0, 2, 0, 0, 0, 0), 0.0, "long", "mf"),
    Constituent("Mm", (0, 1, 0, -1, 0, 0), 0.0, "long", "mm"),
    Constituent("Ssa", (0, 0, 2, 0, 0, 0), 0.0, "long", "unity"),
    Constituent("Sa", (0, 0, 1, 0, 0, 0), 0.0, "long", "unity"),
]
PRINCIPAL = CATALOG[:8]
BY_NAME = {c.name: c for c in CATALOG}


def polynomial(terms: tuple[float, ...], x: str) -> str:
    """Horner's form."""
    out = number(terms[-1])
    for c in reversed(terms[:-1]):
        out = f"({number(c)} + {x} * {out})"
    return out


def rates() -> tuple[float, ...]:
    """Degrees an hour of the six Doodson arguments."""
    s, h, p, n, pp = (x[1] / (36525.0 * 24.0) for x in (MOON, SUN, LUNAR_PERIGEE, LUNAR_NODE, SOLAR_PERIGEE))
    return (15.0 + h - s, s, h, p, n, pp)


def speed(c: Constituent) -> float:
    """Degrees an hour."""
    return sum(d * r for d, r in zip(c.doodson, rates(), strict=True))


def state_steps(us: str = "us") -> Steps:
    """The astronomical state at `us`: jd, s, h, p, n, pp, omega, tau, incl, xi, nu, nup, nupp in degrees."""
    obliquity = tuple(c / 3600.0 / 100.0**k for k, c in enumerate(OBLIQUITY_SECONDS))
    half = f"radians({number(LUNAR_INCLINATION)})"
    ratio = lambda f: f"atan({f}(0.5 * (o - {half})) / {f}(0.5 * (o + {half})) * tan(0.5 * nn)) - 0.5 * nn"
    return [
        {"jd": f"({us} / 86400000000.0 + {number(UNIX_EPOCH_JD)})"},
        {"century": f"((jd - {number(J2000)}) / 36525.0)"},
        {n: mod360(polynomial(c, "century")) for n, c in (("s", MOON), ("h", SUN), ("p", LUNAR_PERIGEE), ("n", LUNAR_NODE), ("pp", SOLAR_PERIGEE), ("omega", obliquity))},
        {"tau": mod360("(jd - floor(jd)) * 360.0 + h - s"), "o": "radians(omega)", "nn": "radians(n)"},
        {"e1": ratio("cos"), "e2": ratio("sin"), "ii": f"acos(greatest(-1.0, least(1.0, cos({half}) * cos(o) - sin({half}) * sin(o) * cos(nn))))"},
        {"incl": "degrees(ii)", "xi": mod360("degrees(-(e1 + e2))"), "nu": mod360("degrees(e1 - e2)"), "vv": "(e1 - e2)"},
        {
            "nup": mod360("degrees(atan2(sin(2 * ii) * sin(vv), sin(2 * ii) * cos(vv) + 0.3347))"),
            "nupp": mod360("degrees(0.5 * atan2(sin(ii) * sin(ii) * sin(2 * vv), sin(ii) * sin(ii) * cos(2 * vv) + 0.0727))"),
        },
    ]


def node_steps() -> Steps:
    """Node factors f_<family> and corrections u_<family> (degrees) from the state."""
    i = f"radians({number(LUNAR_INCLINATION)})"
    less = f"(1 - 1.5 * pow(sin({i}), 2))"
    return [
        {
            "f_unity": "CAST(1.0 AS DOUBLE)",
            "f_m2": f"pow(cos(0.5 * ii), 4) / (pow(cos(0.5 * o), 4) * pow(cos(0.5 * {i}), 4))",
            "f_o1": f"sin(ii) * pow(cos(0.5 * ii), 2) / (sin(o) * pow(cos(0.5 * o), 2) * pow(cos(0.5 * {i}), 4))",
            "f_k1": f"sqrt(0.2523 * pow(sin(2 * ii), 2) + 0.1689 * sin(2 * ii) * cos(vv) + 0.0283) / (0.5023 * sin(2 * o) * {less} + 0.1681)",
            "f_k2": f"sqrt(0.2523 * pow(sin(ii), 4) + 0.0367 * pow(sin(ii), 2) * cos(2 * vv) + 0.0013) / (0.5023 * pow(sin(o), 2) * {less} + 0.0365)",
            "f_mf": f"pow(sin(ii), 2) / (pow(sin(o), 2) * pow(cos(0.5 * {i}), 4))",
            "f_mm": f"({number(2 / 3)} - pow(sin(ii), 2)) / (({number(2 / 3)} - pow(sin(o), 2)) * {less})",
            "u_unity": "CAST(0.0 AS DOUBLE)",
            "u_m2": "2 * xi - 2 * nu",
            "u_o1": "2 * xi - nu",
            "u_k1": "-nup",
            "u_k2": "-2 * nupp",
            "u_mf": "-2 * xi",
            "u_mm": "CAST(0.0 AS DOUBLE)",
        }
    ]


def factor(c: Constituent) -> str:
    return f"f_{c.family}" if c.power == 1 else f"pow(f_{c.family}, {c.power})"


def correction(c: Constituent) -> str:
    """Degrees, not wrapped."""
    return f"u_{c.family}" if c.power == 1 else f"({c.power} * u_{c.family})"


def argument(c: Constituent) -> str:
    """Equilibrium argument V + u in degrees."""
    terms = [f"{d} * {a}" for d, a in zip(c.doodson, ("tau", "s", "h", "p", "n", "pp"), strict=True) if d]
    return f"({' + '.join(terms)} + {number(c.phase0)} + {correction(c)})"


def basis_steps(constituents: list[Constituent]) -> Steps:
    """Columns c_<name> and s_<name>: f cos(V + u) and f sin(V + u). Only the node factors they need are computed."""
    families = {c.family for c in constituents}
    nodes = [{k: v for k, v in node_steps()[0].items() if k[2:] in families}]
    angle = {f"a_{c.name}": f"radians({argument(c)})" for c in constituents}
    return [*state_steps(), *nodes, angle, {k: v for c in constituents for k, v in ((f"c_{c.name}", f"{factor(c)} * cos(a_{c.name})"), (f"s_{c.name}", f"{factor(c)} * sin(a_{c.name})"))}]


def wrapped_correction(c: Constituent) -> str:
    return wrap180(correction(c))
