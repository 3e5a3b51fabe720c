"""Explainable model selection as Spark jobs."""

from tribunal.plans.analysis import Analysis, analyze
from tribunal.sources.readers import read_table
from tribunal.sources.writers import load_run, load_scorer, save_run, save_scorer, write_analysis

__all__ = ["Analysis", "analyze", "load_run", "load_scorer", "read_table", "save_run", "save_scorer", "write_analysis"]
