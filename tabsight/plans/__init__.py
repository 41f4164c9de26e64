"""Plans that run many operators: profiles of tables, models of sets of tables, and their reports."""
