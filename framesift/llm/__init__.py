"""Training-data operators: each module holds one operator and its own, general interface.

``queries`` registers the contract queries; nothing else in the library imports this subpackage.
"""
