"""Fixed schemas of the operational and input tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

ID, COUNT, TEXT, DAY = LongType(), IntegerType(), StringType(), DateType()
MOMENT, FEE, NUMBER = TimestampNTZType(), DecimalType(18, 2), DoubleType()


def schema(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


SCHEMAS: dict[str, StructType] = {
    "funcionarios": schema(
        id_funcionario=ID, nome_funcionario=TEXT, identificador_regime_trab=TEXT, data_saida=DAY
    ),
    "usuario": schema(id_usuario=ID, id_profissional=ID, bloqueado=TEXT, permissao_assinar=TEXT),
    "recibo": schema(id_recibo=ID, arquivado=TEXT, data_arquivado=MOMENT),
    "item_recibo": schema(id_recibo=ID, taxa_1=FEE),
    "movimento_caixa": schema(id_mov_caixa=ID, id_recepcao=ID, data=MOMENT, situacao_pgto=TEXT),
    "item_movimento_caixa": schema(id_mov_caixa=ID, qtde_ato=COUNT, taxa_1=FEE, id_transacao=ID),
    "recepcao_titulo": schema(id_recepcao=ID, id_usuario=ID),
    "transacao_ato": schema(id_transacao=ID, esat_grat_codigo=COUNT),
    "grupo_ato": schema(codigo=COUNT),
    "recepcao_anotacoes": schema(id_recepcao=ID, id_usuario=ID, anotacao=TEXT, excluido=TEXT),
    "livros_notas": schema(id_recepcao=ID, data_reg=MOMENT, ato=COUNT, id_livro_inicio=ID),
}

INPUT_SCHEMAS: dict[str, StructType] = {
    "bonus_assignment": schema(category=TEXT, id_usuario=ID, weight=NUMBER),
    "adjustments": schema(id_usuario=ID, attitude=NUMBER, overtime=NUMBER),
}

# Columns that an input table may have besides.
OPTIONAL: dict[str, StructType] = {name: schema(period=COUNT) for name in INPUT_SCHEMAS}


class _Named:
    """DataFrames by name, each loaded when first asked for."""

    def __init__(self, names: Iterable[str], load: Callable[[str], DataFrame]):
        self._names, self._load, self._loaded = tuple(names), load, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._names:
            raise AttributeError(name)
        if name not in self._loaded:
            self._loaded[name] = self._load(name)
        return self._loaded[name]

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in self._names]


class Tables(_Named):
    """The eleven operational tables, each in the shape given by ``SCHEMAS``.

    ``pruned`` tables hold no more than the partitions that one month's payroll needs.
    """

    def __init__(self, load: Callable[[str], DataFrame], pruned: bool = False):
        super().__init__(SCHEMAS, load)
        self.pruned = pruned


class Inputs(_Named):
    """What the office enters by hand: who gets which allowance, attitude, overtime."""

    def __init__(self, load: Callable[[str], DataFrame]):
        super().__init__(INPUT_SCHEMAS, load)


def conform(
    df: DataFrame, wanted: StructType, table: str, optional: StructType | None = None
) -> DataFrame:
    """Select and cast ``df`` to ``wanted``; names match in any letter case.

    Columns of ``optional`` come first, if they are there.
    """
    present = {c.lower(): c for c in df.columns}
    missing = [f.name for f in wanted.fields if f.name not in present]
    if missing:
        raise ValueError(f"table {table} lacks columns {missing}")
    extra = [f for f in (optional or ()) if f.name in present]
    return df.select(
        [
            F.col(f"`{present[f.name]}`").cast(f.dataType).alias(f.name)
            for f in [*extra, *wanted.fields]
        ]
    )
