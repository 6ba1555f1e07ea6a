"""Typed readers, decoders and writers at the edges of the jobs."""
