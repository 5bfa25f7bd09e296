"""Binary-outcome risk analytics as Spark DataFrame operators."""
