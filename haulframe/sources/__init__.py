"""Reading exports and reference tables, writing cleaned declarations."""
