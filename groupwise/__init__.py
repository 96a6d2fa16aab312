"""Spark jobs for group-composition analytics: who was present, what happened next, and how sure one can be."""
