"""Column expressions and time bounds shared by all plans."""
