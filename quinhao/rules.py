"""Pay rules: sectors, margins, act codes, allowance rates and their allowed ranges."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# ---- Fixed values: these must equal the office's own rules -------------------------------

# Fee-group codes per fee sector.
FEE_GROUPS: dict[str, tuple[int, ...]] = {
    "aut": (3, 8, 46, 33, 62, 55, 5),
    "apo": (63,),
}

# Act codes per deed sector.
ACT_CODES: dict[str, tuple[int, ...]] = {
    "esc": (
        270, 94, 203, 272, 343, 216, 311, 229, 84, 130, 280, 244, 306, 352, 79, 207, 372, 88,
        355, 350, 228, 208, 201, 100, 290, 188, 382, 131, 288, 293, 129, 113, 312, 303, 371,
        313, 199, 369, 341, 89, 248, 361, 195, 365, 185, 297, 287, 305, 187, 86, 389, 101, 227,
        356, 359, 308, 291, 395, 120, 357, 127,
    ),
    "inv": (
        309, 344, 321, 260, 186, 346, 370, 198, 374, 80, 323, 377, 226, 349, 304, 284, 302, 249,
        146, 194, 232, 106, 173,
    ),
    "proc": (
        58, 7, 264, 237, 23, 316, 20, 256, 257, 250, 39, 383, 235, 6, 386, 271, 236, 385, 238,
        251, 222, 259, 215, 217, 21, 25, 24, 390, 176, 241, 22, 384, 401,
    ),
    "dec": (
        242, 57, 335, 252, 398, 268, 218, 399, 108, 266, 110, 107, 267, 262, 179, 263, 275, 269,
        274, 109, 172, 225, 230, 298, 180, 273, 147, 265, 178, 261, 245, 111,
    ),
}

# Annotation prefix that proves each stage of work on a deed (case-sensitive).
STAGE_PREFIXES: dict[str, str] = {"lav": "Lavrad", "conf": "Conferid"}

# Stage name of work proved by a fee item instead of an annotation.
FEE_STAGE = "fee"

# (sector, stage, margin in percent, whether the sector's top producer is boosted).
SECTOR_RULES: tuple[tuple[str, str, float, bool], ...] = (
    ("aut", "fee", 3.5, True),
    ("apo", "fee", 3.5, False),
    ("esc", "lav", 1.5, True),
    ("esc", "conf", 1.5, True),
    ("inv", "lav", 1.5, True),
    ("inv", "conf", 1.5, True),
    ("proc", "lav", 4.5, True),
    ("dec", "lav", 4.0, True),
)

# Order in which a person's sectors are added up.
SECTORS: tuple[str, ...] = ("aut", "apo", "esc", "inv", "proc", "dec")

DEDUCTION = "0.275"  # share taken off gross fees before anything is split
ADMIN_SHARE = 0.0067  # share of the net receipts paid to the administrative staff
TOP_FACTOR = 1.1  # boost of a sector's top producer

BASE_SALARY = 1225.0
SIGNER_ALLOWANCE = 183.75

# Allowance value per weight unit; the administrative one is computed per run.
BONUS_VALUES: dict[str, float] = {
    "esc": 122.50,
    "proc": 122.50,
    "ger": 1041.25,
    "com": 612.50,
    "tap": 102.08,
    "fam": 51.27,
}

# Allowance category -> payroll column, in payroll order.
BONUS_COLUMNS: dict[str, str] = {
    "adm": "prod_administrativo",
    "esc": "grat_escrituras",
    "proc": "grat_procuracoes",
    "ger": "funcao_gerencia",
    "com": "grat_comite",
    "tap": "tarefa_pessoal",
    "fam": "salario_familia",
}

DEFAULT_ATTITUDE = 1.0
DEFAULT_OVERTIME = 0.0

# Allowed range of every input: (table, column) -> (lowest, highest).
INPUT_RANGES: dict[tuple[str, str], tuple[float, float]] = {
    ("sector_rules", "margin"): (0.1, 5.0),
    ("payroll_params", "year"): (2020.0, 2030.0),
    ("payroll_params", "base_salary"): (0.0, 3000.0),
    ("payroll_params", "signer_allowance"): (100.0, 1000.0),
    ("bonus_rates", "value"): (0.0, 2000.0),
    ("bonus_assignment", "weight"): (1.0, 10.0),
    ("adjustments", "attitude"): (1.0, 5.0),
    ("adjustments", "overtime"): (0.0, 1000.0),
    ("bonus_assignment", "year"): (2020.0, 2030.0),
    ("adjustments", "year"): (2020.0, 2030.0),
}

MONTH_NAMES: tuple[str, ...] = (
    "Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho",
    "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro",
)

# ---- End of fixed values -----------------------------------------------------------------


@dataclass(frozen=True)
class PayrollParams:
    """Scalars chosen for one payroll run."""

    base_salary: float = BASE_SALARY
    signer_allowance: float = SIGNER_ALLOWANCE


def _values(spark: SparkSession, rows: Sequence[Sequence[object]], columns: str) -> DataFrame:
    """A literal table the optimizer can size and fold (unlike a parallelized list)."""

    def literal(value: object) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, float):
            return f"CAST('{value!r}' AS DOUBLE)"
        if isinstance(value, int):
            return str(value)
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def _known(
    chosen: Mapping[str, float] | None, names: Collection[str], what: str
) -> dict[str, float]:
    unknown = sorted(set(chosen or ()) - set(names))
    if unknown:
        raise ValueError(f"no such {what}: {unknown}")
    return dict(chosen or {})


def sector_rules(
    spark: SparkSession, margins: Mapping[str, float] | None = None
) -> DataFrame:
    """(sector, stage, margin, boosted); ``margins`` replaces margins by sector.

    Apostilles are paid with the margin of authentications unless given their own.
    """
    chosen = _known(margins, SECTORS, "sector")
    if "aut" in chosen:
        chosen.setdefault("apo", chosen["aut"])
    rows = [(s, st, float(chosen.get(s, m)), b) for s, st, m, b in SECTOR_RULES]
    return _values(spark, rows, "sector, stage, margin, boosted")


def sector_groups(
    spark: SparkSession, groups: Mapping[str, Sequence[int]] = FEE_GROUPS
) -> DataFrame:
    """(sector, codigo): the fee groups that belong to each fee sector."""
    rows = [(sector, code) for sector, codes in groups.items() for code in codes]
    return _values(spark, rows, "sector, codigo")


def sector_acts(
    spark: SparkSession, acts: Mapping[str, Sequence[int]] = ACT_CODES
) -> DataFrame:
    """(sector, stage, ato): the act codes of each deed sector, for each stage it pays."""
    stages = [(sector, stage) for sector, stage, _, _ in SECTOR_RULES if sector in acts]
    rows = [(sector, stage, code) for sector, stage in stages for code in acts[sector]]
    return _values(spark, rows, "sector, stage, ato")


def bonus_rates(
    spark: SparkSession, values: Mapping[str, float] | None = None
) -> DataFrame:
    """(category, value) of the allowances with a set value."""
    merged = {**BONUS_VALUES, **_known(values, BONUS_COLUMNS, "category")}
    return _values(spark, [(c, float(v)) for c, v in merged.items()], "category, value")


def payroll_params(
    spark: SparkSession, params: PayrollParams = PayrollParams(), period: int | None = None
) -> DataFrame:
    """The run's scalars, and its year if it has one, as a one-row table for the range check."""
    row = [float(params.base_salary), float(params.signer_allowance)]
    columns = "base_salary, signer_allowance"
    if period is not None:
        return _values(spark, [(float(period // 100), *row)], f"year, {columns}")
    return _values(spark, [row], columns)
