"""Structured Streaming: subscriptions, live links, running folds."""
