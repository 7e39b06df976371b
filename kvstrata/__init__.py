"""A store of versioned keys as Spark tables: a journal, a ledger of latest states, indexes and hash trees over them."""
