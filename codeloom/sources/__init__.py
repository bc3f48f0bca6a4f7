"""Readers that turn raw inputs into fact rows."""
