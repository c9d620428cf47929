"""Scalar building blocks: Column expressions first, Arrow functions where Spark has none."""
