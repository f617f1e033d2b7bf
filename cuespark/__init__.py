"""Timed-media analytics as Spark jobs: tables of intervals, samples, texts and stage records in, tables out."""
