"""Declaration analytics on Spark: field voting, rules, scoring and tariff search as DataFrame operators."""

__version__ = "0.1.0"
