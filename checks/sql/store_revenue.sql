-- Revenue and baskets per store in a week range.
SELECT
    store_id,
    sum(CAST(rint(sales_value * 10000) AS BIGINT)) / 10000D AS revenue,
    count(DISTINCT basket_id) AS baskets
FROM transaction_data
WHERE week_no BETWEEN :first_week AND :last_week
GROUP BY store_id
