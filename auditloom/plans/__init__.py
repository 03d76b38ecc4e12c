"""Whole jobs put together from the operators: the audit report, the gate and the diff report."""
