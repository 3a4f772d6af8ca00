"""Who is paid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_roster(funcionarios: DataFrame, usuario: DataFrame) -> DataFrame:
    """Contract employees who have not left and whose user is not blocked.

    Returns id_usuario, nome_funcionario and assina (1 for authorised signers, else 0).
    """
    employees = funcionarios.where(
        (F.col("identificador_regime_trab") == "CLT") & F.col("data_saida").isNull()
    )
    users = usuario.where(F.col("bloqueado") == "False")
    return employees.join(
        users, employees.id_funcionario == users.id_profissional
    ).select(
        "id_usuario",
        "nome_funcionario",
        F.when(F.col("permissao_assinar") == "True", 1).otherwise(0).alias("assina"),
    )


def signer_allowance(roster: DataFrame, amount: float) -> DataFrame:
    """Replace the signer flag by the signer's allowance."""
    return roster.withColumn(
        "adicional_escrevente", F.when(F.col("assina") == 1, F.lit(float(amount))).otherwise(0.0)
    ).drop("assina")
