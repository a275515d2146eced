"""Streaming mode of the rolling-window evaluation (see ``rolling``)."""
