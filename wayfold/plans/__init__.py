"""Test-table views, registered queries and the published report queries."""
