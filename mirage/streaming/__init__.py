"""Streaming entry points (see ``mirage.streaming.answering``)."""
