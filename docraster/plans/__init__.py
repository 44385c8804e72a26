"""Whole jobs: batch processing, the detector report, and the registered queries."""
