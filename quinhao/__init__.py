"""Production payroll and revenue-pool allocation as Spark DataFrame operators."""
