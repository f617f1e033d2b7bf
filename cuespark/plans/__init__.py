"""Registered queries; importing the area modules fills the registry."""
