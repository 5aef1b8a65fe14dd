"""Audits structured claims against the material they come from, as DataFrame operators."""
