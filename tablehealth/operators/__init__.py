"""Skew, history, profiling, recommendation, hierarchy, layout and job operators."""
