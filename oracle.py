"""Independent SQL for every registered query, one statement per sector and stage.

Runs on the star-schema tables. Deliberately shaped differently from the Spark plans: raw
many-way joins, an exclusion list per stage, distinct counts, one block per sector.
"""

from __future__ import annotations

from quinhao import rules as R

MONTH = 199603

BINDINGS = """
funcionarios AS (SELECT s_suppkey AS id_funcionario, s_name AS nome_funcionario,
  CASE WHEN s_nationkey % 5 = 0 THEN 'PJ' ELSE 'CLT' END AS identificador_regime_trab,
  CASE WHEN s_acctbal < 0 THEN DATE '1999-01-01' END AS data_saida FROM supplier),
usuario AS (SELECT s_suppkey AS id_usuario, s_suppkey AS id_profissional,
  CASE WHEN s_suppkey % 10 = 9 THEN 'True' ELSE 'False' END AS bloqueado,
  CASE WHEN s_nationkey % 2 = 0 THEN 'True' ELSE 'False' END AS permissao_assinar FROM supplier),
recibo AS (SELECT o_orderkey AS id_recibo,
  CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END AS arquivado,
  o_orderdate AS data_arquivado FROM orders),
item_recibo AS (SELECT l_orderkey AS id_recibo,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS taxa_1 FROM lineitem),
movimento_caixa AS (SELECT o_orderkey AS id_mov_caixa, o_orderkey AS id_recepcao,
  o_orderdate AS data,
  CASE WHEN o_orderstatus = 'P' THEN 'Pendente' ELSE 'Liquidado' END AS situacao_pgto
  FROM orders),
item_movimento_caixa AS (SELECT l_orderkey AS id_mov_caixa, CAST(l_quantity AS INT) AS qtde_ato,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS taxa_1, l_partkey AS id_transacao FROM lineitem),
recepcao_titulo AS (SELECT l_orderkey AS id_recepcao, MIN(l_suppkey) AS id_usuario
  FROM lineitem GROUP BY l_orderkey),
transacao_ato AS (SELECT p_partkey AS id_transacao,
  CASE p_size WHEN 50 THEN 63 WHEN 49 THEN 62 WHEN 48 THEN 55 ELSE p_size END AS esat_grat_codigo
  FROM part),
grupo_ato AS (SELECT DISTINCT
  CASE p_size WHEN 50 THEN 63 WHEN 49 THEN 62 WHEN 48 THEN 55 ELSE p_size END AS codigo
  FROM part),
recepcao_anotacoes AS (SELECT l_orderkey AS id_recepcao, l_suppkey AS id_usuario,
  CASE l_returnflag WHEN 'A' THEN 'Lavrado em cartorio' WHEN 'R' THEN 'Conferido'
    ELSE 'Outro' END AS anotacao,
  CASE WHEN l_linestatus = 'F' THEN 'False' ELSE 'True' END AS excluido FROM lineitem),
livros_notas AS (SELECT o_orderkey AS id_recepcao, o_orderdate AS data_reg,
  CASE o_custkey % 10 WHEN 0 THEN 270 WHEN 1 THEN 94 WHEN 2 THEN 309 WHEN 3 THEN 344
    WHEN 4 THEN 58 WHEN 5 THEN 7 WHEN 6 THEN 242 WHEN 7 THEN 57 ELSE 999 END AS ato,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderkey END AS id_livro_inicio
  FROM orders),
adjustments AS (SELECT s_suppkey AS id_usuario, CAST(1 + s_suppkey % 5 AS DOUBLE) AS attitude,
  CAST((s_suppkey % 3) * 12.5 AS DOUBLE) AS overtime FROM supplier WHERE s_suppkey % 4 <> 3),
bonus_assignment AS (SELECT c.category, s_suppkey AS id_usuario,
  CAST(1 + (s_suppkey % 4) * 0.5 AS DOUBLE) AS weight
  FROM supplier, (VALUES ('adm', 11), ('esc', 7), ('proc', 5), ('ger', 13), ('com', 6),
    ('tap', 3), ('fam', 2)) AS c(category, every) WHERE s_suppkey % c.every = 0)
"""


def _period(column: str) -> str:
    return (
        f"CAST(EXTRACT(YEAR FROM {column}) * 100 + EXTRACT(MONTH FROM {column}) AS INTEGER)"
    )


def _codes(codes) -> str:
    return ", ".join(str(c) for c in codes)


def _values(rows) -> str:
    def text(v):
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return f"'{v}'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)


RULES = f"sector_rules(sector, stage, margin, boosted) AS (VALUES {_values(R.SECTOR_RULES)})"

ROSTER = """
roster AS (SELECT u.id_usuario, f.nome_funcionario,
  CAST(CASE WHEN u.permissao_assinar = 'True' THEN 1 ELSE 0 END AS INTEGER) AS assina
  FROM funcionarios f JOIN usuario u ON f.id_funcionario = u.id_profissional
  WHERE f.identificador_regime_trab = 'CLT' AND f.data_saida IS NULL AND u.bloqueado = 'False')
"""

ADMIN = """
admin_pool AS (SELECT CAST(SUM(i.taxa_1) AS DECIMAL(28,2)) AS fees
  FROM item_recibo i JOIN recibo r ON r.id_recibo = i.id_recibo
  WHERE r.arquivado = 'True' AND EXTRACT(YEAR FROM r.data_arquivado) = 1996
    AND EXTRACT(MONTH FROM r.data_arquivado) = 3),
admin_selected AS (SELECT CAST(GREATEST(COUNT(DISTINCT a.id_usuario), 1) AS BIGINT) AS selected
  FROM bonus_assignment a WHERE a.category = 'adm'
    AND a.id_usuario IN (SELECT id_usuario FROM roster)),
admin_share AS (SELECT fees, selected, COALESCE(CAST(fees - fees * CAST(0.275 AS DECIMAL(4,3))
    AS DOUBLE) * CAST(0.0067 AS DOUBLE) / selected, 0) AS value
  FROM admin_pool, admin_selected)
"""


def _fee_sector(sector: str) -> str:
    return f"""
acts_{sector} AS (SELECT {_period("m.data")} AS period, '{sector}' AS sector, 'fee' AS stage,
  t.id_usuario, CAST(SUM(i.qtde_ato) AS DOUBLE) AS acts,
  CAST(SUM(i.taxa_1) AS DECIMAL(28,2)) AS fees
  FROM movimento_caixa m JOIN item_movimento_caixa i ON i.id_mov_caixa = m.id_mov_caixa
  JOIN recepcao_titulo t ON t.id_recepcao = m.id_recepcao
  LEFT JOIN transacao_ato a ON a.id_transacao = i.id_transacao
  LEFT JOIN grupo_ato g ON g.codigo = a.esat_grat_codigo
  WHERE g.codigo IN ({_codes(R.FEE_GROUPS[sector])}) GROUP BY ALL)"""


def _ignored(stage: str) -> str:
    return f"""
ignored_{stage} AS (SELECT {_period("b.data_reg")} AS period, n.id_recepcao,
  COUNT(*) AS quantidade
  FROM recepcao_anotacoes n JOIN livros_notas b ON b.id_recepcao = n.id_recepcao
  WHERE n.anotacao LIKE '{R.STAGE_PREFIXES[stage]}%' AND n.excluido = 'False'
    AND b.id_livro_inicio IS NOT NULL
  GROUP BY ALL HAVING COUNT(*) > 1)"""


def _deed_sector(sector: str, stage: str) -> str:
    return f"""
acts_{sector}_{stage} AS (SELECT {_period("b.data_reg")} AS period, '{sector}' AS sector,
  '{stage}' AS stage, n.id_usuario, CAST(COUNT(DISTINCT m.id_recepcao) AS DOUBLE) AS acts,
  CAST(SUM(i.taxa_1) AS DECIMAL(28,2)) AS fees
  FROM movimento_caixa m JOIN item_movimento_caixa i ON i.id_mov_caixa = m.id_mov_caixa
  JOIN recepcao_anotacoes n ON n.id_recepcao = m.id_recepcao
  JOIN livros_notas b ON b.id_recepcao = m.id_recepcao
  WHERE m.situacao_pgto = 'Liquidado' AND n.excluido = 'False'
    AND n.anotacao LIKE '{R.STAGE_PREFIXES[stage]}%' AND b.id_livro_inicio IS NOT NULL
    AND b.ato IN ({_codes(R.ACT_CODES[sector])})
    AND ({_period("b.data_reg")}, m.id_recepcao) NOT IN
      (SELECT (period, id_recepcao) FROM ignored_{stage})
  GROUP BY ALL)"""


FEE_SECTORS = [s for s, st, _, _ in R.SECTOR_RULES if st == R.FEE_STAGE]
DEED_SECTORS = [(s, st) for s, st, _, _ in R.SECTOR_RULES if st != R.FEE_STAGE]

FEE_ACTS = ",".join(
    [_fee_sector(s) for s in FEE_SECTORS]
    + ["\nfee_acts AS (" + " UNION ALL ".join(f"SELECT * FROM acts_{s}" for s in FEE_SECTORS) + ")"]
)
DEED_ACTS = ",".join(
    [_ignored(st) for st in R.STAGE_PREFIXES]
    + [_deed_sector(s, st) for s, st in DEED_SECTORS]
    + [
        "\ndeed_acts AS ("
        + " UNION ALL ".join(f"SELECT * FROM acts_{s}_{st}" for s, st in DEED_SECTORS)
        + ")"
    ]
)

TOTALS = """
acts AS (SELECT * FROM fee_acts UNION ALL SELECT * FROM deed_acts),
sector_totals AS (SELECT period, sector, stage, CAST(SUM(fees) AS DECIMAL(28,2)) AS fees,
  SUM(acts) AS total_acts,
  CAST(SUM(fees) AS DECIMAL(28,2))
    - CAST(SUM(fees) AS DECIMAL(28,2)) * CAST(0.275 AS DECIMAL(4,3)) AS net
  FROM acts GROUP BY period, sector, stage)
"""

ALLOCATION = """
allocation AS (SELECT a.period, a.sector, a.stage, a.id_usuario, a.acts,
  CAST(t.net AS DOUBLE) * (a.acts / NULLIF(t.total_acts, 0)) * r.margin / 100 AS production
  FROM acts a JOIN sector_totals t USING (period, sector, stage)
  JOIN sector_rules r USING (sector, stage)),
sector_production AS (SELECT period, sector, id_usuario,
  COALESCE(SUM(production), 0) AS production
  FROM allocation GROUP BY period, sector, id_usuario),
boosted AS (SELECT p.period, p.sector, p.id_usuario,
  CASE WHEN p.sector <> 'apo' AND p.production = MAX(p.production)
    OVER (PARTITION BY p.period, p.sector)
  THEN p.production * CAST(1.1 AS DOUBLE) ELSE p.production END AS production
  FROM sector_production p)
"""


def _part(sector: str) -> str:
    return f"COALESCE(SUM(production) FILTER (WHERE sector = '{sector}'), 0)"


TOTAL = f"""
production_total AS (SELECT period, id_usuario,
  {" + ".join(_part(s) for s in R.SECTORS)} AS production
  FROM boosted GROUP BY period, id_usuario),
months AS (SELECT {_period("data")} AS period FROM movimento_caixa WHERE data IS NOT NULL
  UNION SELECT {_period("data_reg")} FROM livros_notas WHERE data_reg IS NOT NULL),
payroll_production AS (SELECT s.period, s.id_usuario, s.nome_funcionario, s.assina,
  COALESCE(t.production, 0) AS production
  FROM (SELECT * FROM roster, months) s
  LEFT JOIN production_total t ON t.period = s.period AND t.id_usuario = s.id_usuario)
"""


def _bonus(category: str, column: str) -> str:
    return (
        "COALESCE((SELECT SUM(r.value * a.weight) FROM bonus_assignment a"
        f" JOIN bonus_rates r ON r.category = a.category WHERE a.category = '{category}'"
        f" AND a.id_usuario = p.id_usuario), 0) AS {column}"
    )


BONUS_COLUMNS = list(R.BONUS_COLUMNS.values())
BONUS = f"""
bonus_rates AS (SELECT * FROM (VALUES {_values(list(R.BONUS_VALUES.items()))}) AS v(category, value)
  UNION ALL SELECT 'adm', value FROM admin_share),
bonus_wide AS (SELECT p.id_usuario, p.nome_funcionario, p.assina,
  {", ".join(_bonus(c, col) for c, col in R.BONUS_COLUMNS.items())} FROM roster p)
"""


def _round2(expression: str) -> str:
    return f"round_even(({expression}) * 100, 0) / 100"


PAYROLL = f"""
rounded AS (SELECT p.period, p.id_usuario, p.nome_funcionario,
  {_round2(repr(R.BASE_SALARY))} AS salario_base, {_round2("p.production")} AS production,
  {_round2(f"CASE p.assina WHEN 1 THEN {R.SIGNER_ALLOWANCE!r} ELSE 0 END")}
    AS adicional_escrevente,
  {", ".join(f"{_round2('b.' + c)} AS {c}" for c in BONUS_COLUMNS)},
  COALESCE(j.attitude, 1.0) AS attitude, COALESCE(j.overtime, 0.0) AS horas_extras
  FROM payroll_production p JOIN bonus_wide b USING (id_usuario)
  LEFT JOIN adjustments j USING (id_usuario)),
raised AS (SELECT *, production + production * (attitude / 100) AS produtividade FROM rounded),
payroll AS (SELECT period, id_usuario, nome_funcionario,
  CAST(salario_base AS DOUBLE) AS salario_base, produtividade,
  CAST(adicional_escrevente AS DOUBLE) AS adicional_escrevente, {", ".join(BONUS_COLUMNS)},
  CAST(horas_extras AS DOUBLE) AS horas_extras,
  salario_base + produtividade + adicional_escrevente + {" + ".join(BONUS_COLUMNS)}
    + horas_extras AS salario
  FROM raised)
"""

PRODUCTION_PARTS = (BINDINGS, RULES, FEE_ACTS, DEED_ACTS, TOTALS, ALLOCATION)
PAYROLL_PARTS = (*PRODUCTION_PARTS, ROSTER, ADMIN, TOTAL, BONUS, PAYROLL)


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


def _at(column: str, digits: int, alias: str | None = None) -> str:
    scale = 10**digits
    return f"round_even({column} * {scale}, 0) / {scale} AS {alias or column}"


PAY = ["salario_base", "produtividade", "adicional_escrevente", *BONUS_COLUMNS, "horas_extras",
       "salario"]
PAY_SELECT = "SELECT period, id_usuario, nome_funcionario, " + ", ".join(_at(c, 4) for c in PAY)

ACTS_SELECT = (
    "SELECT period, sector, stage, id_usuario, acts, CAST(fees AS DOUBLE) AS fees"
)

ORACLE_TABLES = [
    "funcionarios", "usuario", "recibo", "item_recibo", "movimento_caixa",
    "item_movimento_caixa", "recepcao_titulo", "transacao_ato", "grupo_ato",
    "recepcao_anotacoes", "livros_notas",
]


def oracle_sql() -> dict[str, str]:
    base = _with(BINDINGS)
    faulty = f"""adjustments AS (SELECT
        CASE s_suppkey % 9 WHEN 0 THEN 201912 WHEN 1 THEN 203101 ELSE 202103 END AS period,
        s_suppkey AS id_usuario, CASE s_suppkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 6.0 ELSE 2.0 END
          AS attitude, CASE WHEN s_suppkey % 8 = 0 THEN -1.0 ELSE 5.0 END AS overtime
        FROM supplier, range(CASE WHEN s_suppkey % 15 = 0 THEN 2 ELSE 1 END)),
      bonus_assignment AS (SELECT
        CASE s_suppkey % 6 WHEN 0 THEN 'bonus' WHEN 1 THEN NULL ELSE 'esc' END AS category,
        s_suppkey AS id_usuario,
        CASE s_suppkey % 5 WHEN 0 THEN 0.5 WHEN 1 THEN NULL ELSE 1.0 END AS weight
        FROM supplier, range(CASE WHEN s_suppkey % 20 = 0 THEN 3 ELSE 1 END))"""
    assigned = "coalesce(category, '?') || '/' || id_usuario"
    adjusted = "period || '/' || id_usuario"
    # table, row key, column, what is compared, range
    violations = [
        ("sector_rules", "sector || '/' || stage", "margin", "margin", 0.1, 5.0),
        ("bonus_rates", "category", "value", "value", 0.0, 2000.0),
        ("f.bonus_assignment", assigned, "weight", "weight", 1.0, 10.0),
        ("f.adjustments", adjusted, "attitude", "attitude", 1.0, 5.0),
        ("f.adjustments", adjusted, "overtime", "overtime", 0.0, 1000.0),
        ("f.adjustments", adjusted, "year", "period // 100", 2020.0, 2030.0),
        ("run", "''", "year", "year", 2020.0, 2030.0),
    ]

    def violation(table: str, key: str, column: str, value: str, low: float, high: float) -> str:
        name = {"run": "payroll_params"}.get(table, table.removeprefix("f."))
        return (
            f"SELECT '{name}' AS \"table\", {key} AS key,"
            f" CASE WHEN {value} IS NULL THEN 'missing' ELSE 'range' END AS problem,"
            f" '{column}' AS \"column\", {_at(f'CAST({value} AS DOUBLE)', 4, 'value')},"
            f" CAST({low} AS DOUBLE) AS low, CAST({high} AS DOUBLE) AS high"
            f" FROM {table.replace('f.', 'faulty_')}"
            f" WHERE {value} IS NULL OR {value} < {low} OR {value} > {high}"
        )

    def other(table: str, key: str, problem: str, column: str, value: str, rest: str) -> str:
        return (
            f"SELECT '{table}', {key}, '{problem}', '{column}', CAST({value} AS DOUBLE), NULL, NULL"
            f" FROM faulty_{table} {rest}"
        )

    off = "WHERE id_usuario NOT IN (SELECT id_usuario FROM roster)"
    violations_sql = " UNION ALL ".join(
        [violation(*v) for v in violations]
        + [
            other("bonus_assignment", assigned, "unknown", "category", "NULL",
                  "WHERE category IS NULL OR category NOT IN"
                  " ('adm', 'esc', 'proc', 'ger', 'com', 'tap', 'fam')"),
            other("bonus_assignment", assigned, "repeated", "entries", "COUNT(*)",
                  "GROUP BY category, id_usuario HAVING COUNT(*) > 1"),
            other("adjustments", adjusted, "repeated", "entries", "COUNT(*)",
                  "GROUP BY period, id_usuario HAVING COUNT(*) > 1"),
            other("bonus_assignment", assigned, "off roster", "id_usuario", "NULL", off),
            other("adjustments", adjusted, "off roster", "id_usuario", "NULL", off),
        ]
    )
    faulty = faulty.replace("adjustments AS", "faulty_adjustments AS").replace(
        "bonus_assignment AS", "faulty_bonus_assignment AS"
    )
    monthly = _with(*PAYROLL_PARTS).replace(
        BONUS.strip(),
        f"""monthly_assignment AS (SELECT
        CASE WHEN s_suppkey % 2 = 0 THEN 199603 ELSE 199604 END AS period,
        CASE WHEN s_suppkey % 3 = 0 THEN 'esc' ELSE 'fam' END AS category,
        s_suppkey AS id_usuario, 1 + (s_suppkey % 4) * 0.5 AS weight FROM supplier),
      monthly_adjustments AS (SELECT m.period, s_suppkey AS id_usuario,
        CAST(1 + s_suppkey % 5 AS DOUBLE) AS attitude,
        CAST((s_suppkey % 3) * 12.5 AS DOUBLE) AS overtime
        FROM supplier, (VALUES (199603), (199604)) AS m(period)),
      bonus_wide AS (SELECT m.period, p.id_usuario,
        {", ".join(
            f"COALESCE((SELECT SUM(CAST({R.BONUS_VALUES.get(c, 0)!r} AS DOUBLE) * a.weight)"
            f" FROM monthly_assignment a WHERE a.category = '{c}' AND a.period = m.period"
            f" AND a.id_usuario = p.id_usuario), 0) AS {col}"
            for c, col in R.BONUS_COLUMNS.items()
        )}
        FROM roster p, (SELECT DISTINCT period FROM payroll_production) m)""",
    )
    monthly = monthly.replace(
        "JOIN bonus_wide b USING (id_usuario)", "JOIN bonus_wide b USING (period, id_usuario)"
    ).replace(
        "LEFT JOIN adjustments j USING (id_usuario)",
        "LEFT JOIN monthly_adjustments j USING (period, id_usuario)",
    )

    by_month = {
        "movimento_caixa": (_period("data"), "movimento_caixa"),
        "livros_notas": (_period("data_reg"), "livros_notas"),
        "item_movimento_caixa": (
            _period("m.data"), "item_movimento_caixa LEFT JOIN movimento_caixa m USING (id_mov_caixa)"
        ),
        "recibo": (f"CASE WHEN arquivado = 'True' THEN {_period('data_arquivado')} END", "recibo"),
        "item_recibo": (
            f"CASE WHEN r.arquivado = 'True' THEN {_period('r.data_arquivado')} END",
            "item_recibo LEFT JOIN recibo r USING (id_recibo)",
        ),
        "recepcao_titulo": ("home", "recepcao_titulo LEFT JOIN homes USING (id_recepcao)"),
        "recepcao_anotacoes": ("home", "recepcao_anotacoes LEFT JOIN homes USING (id_recepcao)"),
    }
    layout = (
        _with(
            BINDINGS,
            f"""homes AS (SELECT id_recepcao, COALESCE(MIN(moved), MIN(book)) AS home FROM (
            SELECT id_recepcao, {_period("data")} AS moved, NULL AS book FROM movimento_caixa
            UNION ALL SELECT id_recepcao, NULL, {_period("data_reg")} FROM livros_notas)
            GROUP BY id_recepcao)""",
        )
        + " UNION ALL ".join(
            f"SELECT '{name}' AS \"table\", COALESCE({period}, 0) AS period, COUNT(*) AS n, "
            + ("CAST(SUM(taxa_1) AS DOUBLE)" if "item" in name else "CAST(NULL AS DOUBLE)")
            + f" AS fees FROM {source} GROUP BY COALESCE({period}, 0)"
            for name, (period, source) in by_month.items()
        )
    )

    names = " ".join(
        f"WHEN {i} THEN '{name}'" for i, name in enumerate(R.MONTH_NAMES, start=1)
    )
    pair_counts = " UNION ALL ".join(
        f"""SELECT {_period("b.data_reg")} AS period, '{stage}' AS stage, n.id_recepcao,
        COUNT(*) AS pairs, MIN(n.id_usuario) AS u, MIN(b.ato) AS a
        FROM recepcao_anotacoes n JOIN livros_notas b USING (id_recepcao)
        WHERE n.anotacao LIKE '{prefix}%' AND n.excluido = 'False'
          AND b.id_livro_inicio IS NOT NULL AND b.data_reg IS NOT NULL GROUP BY ALL"""
        for stage, prefix in R.STAGE_PREFIXES.items()
    )
    fee_codes = " UNION ALL ".join(
        f"""SELECT '{s}' AS sector, 'fee' AS stage, esat_grat_codigo AS code
        FROM transacao_ato WHERE esat_grat_codigo IN ({_codes(R.FEE_GROUPS[s])})"""
        for s in FEE_SECTORS
    )
    deed_codes = " UNION ALL ".join(
        f"""SELECT '{s}', '{st}', ato FROM livros_notas
        WHERE ato IN ({_codes(R.ACT_CODES[s])})"""
        for s, st in DEED_SECTORS
    )
    return {
        "scan_tables": base
        + " UNION ALL ".join(
            f"SELECT '{t}' AS \"table\", COUNT(*) AS n FROM {t}" for t in ORACLE_TABLES
        ),
        "period_filter": base
        + f"""SELECT id_mov_caixa, id_recepcao, {_period("data")} AS period, situacao_pgto
        FROM movimento_caixa WHERE EXTRACT(YEAR FROM data) = {MONTH // 100}
        AND EXTRACT(MONTH FROM data) = {MONTH % 100}""",
        "period_label": base
        + f"""SELECT {_period("data")} AS period,
        CASE EXTRACT(MONTH FROM data) {names} END AS label,
        COUNT(*) AS movements FROM movimento_caixa GROUP BY ALL""",
        "sector_rules": _with(BINDINGS, RULES)
        + f"""SELECT r.sector, r.stage, r.margin, r.boosted, COUNT(DISTINCT c.code) AS codes,
        COUNT(c.code) AS uses FROM sector_rules r
        LEFT JOIN ({fee_codes} UNION ALL {deed_codes}) c
        ON c.sector = r.sector AND c.stage = r.stage GROUP BY ALL""",
        "active_roster": _with(BINDINGS, ROSTER) + "SELECT * FROM roster",
        "signer_allowance": _with(BINDINGS, ROSTER)
        + f"""SELECT id_usuario, nome_funcionario, CAST(CASE assina WHEN 1
        THEN {R.SIGNER_ALLOWANCE!r} ELSE 0 END AS DOUBLE) AS adicional_escrevente FROM roster""",
        "admin_pool": _with(BINDINGS, ROSTER, ADMIN)
        + "SELECT CAST(fees AS DOUBLE) AS fees FROM admin_pool",
        "admin_share": _with(BINDINGS, ROSTER, ADMIN)
        + "SELECT CAST(fees AS DOUBLE) AS fees, selected, "
        + f"{_at('value', 4)} FROM admin_share",
        "movement_enriched": base
        + f"""SELECT {_period("m.data")} AS period, m.id_recepcao, t.id_usuario, i.id_transacao,
        g.codigo, CAST(SUM(i.qtde_ato) AS BIGINT) AS acts,
        CAST(SUM(i.taxa_1) AS DOUBLE) AS fees, COUNT(*) AS items
        FROM movimento_caixa m JOIN item_movimento_caixa i USING (id_mov_caixa)
        JOIN recepcao_titulo t ON t.id_recepcao = m.id_recepcao
        LEFT JOIN transacao_ato a ON a.id_transacao = i.id_transacao
        LEFT JOIN grupo_ato g ON g.codigo = a.esat_grat_codigo GROUP BY ALL""",
        "fee_acts": _with(BINDINGS, FEE_ACTS) + ACTS_SELECT + " FROM fee_acts",
        "stage_pairs": base
        + f"""SELECT period, stage, id_recepcao, CAST(pairs AS DOUBLE) AS pairs,
        CASE WHEN pairs = 1 THEN u END
        AS id_usuario, CASE WHEN pairs = 1 THEN a END AS ato FROM ({pair_counts})""",
        "ambiguous_receptions": base
        + "SELECT period, stage, id_recepcao, CAST(pairs AS DOUBLE) AS quantidade"
        f" FROM ({pair_counts}) WHERE pairs > 1",
        "ambiguous_list": base
        + f"""SELECT period, stage, id_recepcao // 1000 AS block,
        COALESCE(STRING_AGG(CASE WHEN pairs > 1 THEN CAST(id_recepcao AS VARCHAR) END, ','
          ORDER BY id_recepcao), '0') AS receptions FROM ({pair_counts}) GROUP BY ALL""",
        "deed_acts": _with(BINDINGS, DEED_ACTS) + ACTS_SELECT + " FROM deed_acts",
        "sector_totals": _with(BINDINGS, FEE_ACTS, DEED_ACTS, TOTALS)
        + "SELECT period, sector, stage, CAST(fees AS DOUBLE) AS fees, total_acts,"
        f" {_at('CAST(net AS DOUBLE)', 4, 'net')} FROM sector_totals",
        "pool_allocation": _with(*PRODUCTION_PARTS)
        + f"SELECT period, sector, stage, id_usuario, acts, {_at('production', 4)} FROM allocation",
        "sector_production": _with(*PRODUCTION_PARTS)
        + f"SELECT period, sector, id_usuario, {_at('production', 4)} FROM sector_production",
        "top_boost": _with(*PRODUCTION_PARTS)
        + f"SELECT period, sector, id_usuario, {_at('production', 4)} FROM boosted",
        "production_total": _with(*PRODUCTION_PARTS, ROSTER, TOTAL)
        + f"SELECT period, id_usuario, {_at('production', 4)} FROM production_total",
        "boosted_total": _with(*PRODUCTION_PARTS, ROSTER, TOTAL)
        + f"SELECT period, id_usuario, {_at('production', 4)} FROM production_total",
        "payroll_production": _with(*PRODUCTION_PARTS, ROSTER, TOTAL)
        + f"SELECT period, id_usuario, nome_funcionario, {_at('production', 4)}"
        " FROM payroll_production",
        "bonus_wide": _with(BINDINGS, ROSTER, ADMIN, BONUS)
        + "SELECT id_usuario, nome_funcionario, "
        + ", ".join(_at(c, 4) for c in BONUS_COLUMNS)
        + " FROM bonus_wide",
        "adjustments_apply": _with(*PAYROLL_PARTS)
        + f"SELECT period, id_usuario, {_at('produtividade', 4)}, {_at('horas_extras', 4)}"
        " FROM payroll",
        "input_violations": _with(
            BINDINGS, RULES, ROSTER, ADMIN, BONUS, faulty,
            f"run AS (SELECT CAST({MONTH // 100} AS DOUBLE) AS year)",
        )
        + violations_sql,
        "payroll_monthly_inputs": monthly + PAY_SELECT + " FROM payroll",
        "payroll_month": _with(*PAYROLL_PARTS)
        + PAY_SELECT
        + f" FROM payroll WHERE period = {MONTH}",
        "payroll_layout": _with(*PAYROLL_PARTS)
        + PAY_SELECT
        + f" FROM payroll WHERE period = {MONTH}",
        "layout_tables": layout,
        "payroll_all": _with(*PAYROLL_PARTS) + PAY_SELECT + " FROM payroll",
        "payroll_export": _with(*PAYROLL_PARTS)
        + "SELECT period, id_usuario, nome_funcionario, "
        + ", ".join(_at(c, 4) for c in PAY)
        + ", "
        + ", ".join(_at(c, 2, f"csv_{c}") for c in PAY)
        + " FROM payroll",
    }
