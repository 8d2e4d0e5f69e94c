"""Composed jobs: corpus to catalogue, catalogue to requests, checks."""
