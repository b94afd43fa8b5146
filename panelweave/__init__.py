"""panelweave: price panels, portfolios and investor profiles as Spark jobs.

Every operator is a lazy ``DataFrame -> DataFrame`` function over tidy tables, so one job
covers all tickers, all portfolios and all users at once.
"""
