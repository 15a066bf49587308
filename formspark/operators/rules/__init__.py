"""Quality rules over form definitions: a registry of ``DataFrame -> findings``."""

from formspark.operators.rules import form_rules  # noqa: F401 - registers the rules
from formspark.operators.rules.registry import RULES, Model, audit, finding_order, register, run_rules, with_titles

__all__ = ["RULES", "Model", "audit", "finding_order", "register", "run_rules", "with_titles"]
