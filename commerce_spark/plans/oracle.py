"""DuckDB SQL for the named queries, written apart from the DataFrame plans: common table expressions and one SELECT each."""

from __future__ import annotations

_CTE = {
    "cal": "SELECT CAST(m AS DATE) AS month, (year(m)-1995)*12+month(m)-1 AS i FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-02', INTERVAL 1 MONTH) r(m)",
    "sale": """SELECT l_orderkey AS entry, l_linenumber, CAST(o_orderdate AS DATE) AS sale_date, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_custkey AS customer, l_suppkey AS seller, l_partkey AS product,
        CAST(l_quantity AS BIGINT) AS quantity, CAST(CAST(l_extendedprice AS DECIMAL(12,2))*(1-CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS revenue,
        CAST(CAST(l_quantity AS BIGINT)*CAST(p_retailprice AS DECIMAL(12,2)) AS DECIMAL(18,4)) AS cost,
        CAST(CAST(l_extendedprice AS DECIMAL(12,2))*(1-CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) - CAST(CAST(l_quantity AS BIGINT)*CAST(p_retailprice AS DECIMAL(12,2)) AS DECIMAL(18,4)) AS margin,
        CASE WHEN o_orderstatus='P' THEN 'cancelled' ELSE 'invoiced' END AS status
        FROM lineitem JOIN orders ON l_orderkey=o_orderkey LEFT JOIN part ON l_partkey=p_partkey""",
    "inv": "SELECT * FROM sale WHERE status='invoiced'",
    "target": "SELECT month, s_suppkey AS seller, CAST(115000+2500*i+7000*(s_suppkey%10) AS DECIMAL(18,2)) AS target FROM supplier CROSS JOIN cal",
    "forecast": "SELECT CAST(month - to_months(CAST(h//30 AS INTEGER)) AS DATE) AS issued, month, h AS horizon, CAST((510000+9500*i)*(100+(i+h)%7-3) AS DECIMAL(18,4))*CAST(0.01 AS DECIMAL(4,2)) AS forecast FROM cal CROSS JOIN (VALUES (30),(60),(120)) t(h)",
    "back": """SELECT l_orderkey AS entry, l_suppkey AS seller, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus='P' AS cancelled,
        CAST((2*CAST(CAST(l_extendedprice AS DECIMAL(12,2))*(1-CAST(l_discount AS DECIMAL(4,2)))*10000 AS BIGINT)*((CAST(l_quantity AS BIGINT)+1)//2) + CAST(l_quantity AS BIGINT)*100) // (2*CAST(l_quantity AS BIGINT)*100) AS DECIMAL(18,2))*CAST(0.01 AS DECIMAL(4,2)) AS value
        FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE l_returnflag='R'""",
    "cm": "SELECT month, customer, SUM(revenue) AS rev, SUM(margin) AS mar FROM inv GROUP BY 1,2",
    "prev": "SELECT *, (year(month)-year(before))*12+month(month)-month(before) AS gap FROM (SELECT *, LAG(month) OVER w AS before, LAG(rev) OVER w AS rev0, LAG(mar) OVER w AS mar0 FROM cm WINDOW w AS (PARTITION BY customer ORDER BY month))",
    "exec": """SELECT month, rev, mar, cust, ent, goal, LAG(rev,1) OVER (ORDER BY month) AS m1, LAG(rev,12) OVER (ORDER BY month) AS m12 FROM (SELECT month, SUM(revenue) AS rev, SUM(margin) AS mar, COUNT(DISTINCT customer) AS cust, COUNT(DISTINCT entry) AS ent FROM inv GROUP BY 1)
        LEFT JOIN (SELECT month, SUM(target) AS goal FROM target GROUP BY 1) USING (month)""",
    "vint": """SELECT *, rev - coalesce(back,0) AS after FROM (SELECT month, seller, COUNT(*) AS n, COUNT(*) FILTER (status='cancelled') AS cancelled, coalesce(SUM(revenue) FILTER (status='invoiced'),0) AS rev FROM sale GROUP BY 1,2)
        LEFT JOIN (SELECT month, seller, SUM(value) AS back FROM back WHERE NOT cancelled GROUP BY 1,2) USING (month, seller)""",
    "vint2": "SELECT * FROM vint FULL JOIN target USING (month, seller) JOIN supplier ON seller=s_suppkey LEFT JOIN nation ON s_nationkey=n_nationkey WHERE month>=DATE '2000-08-01' AND month<DATE '2001-08-01'",
    "ver": """SELECT concat_ws('-', CAST(id_cliente AS VARCHAR), strftime(valid_from,'%Y%m%d')) AS chave_cliente, id_cliente, nome, id_vendedor, r_name AS regiao, ativo, valid_from, LEAD(valid_from) OVER (PARTITION BY id_cliente ORDER BY valid_from) AS valid_to FROM (
        SELECT c_custkey AS id_cliente, c_name AS nome, c_nationkey, c_custkey%n+1 AS id_vendedor, true AS ativo, TIMESTAMP '1994-12-01' AS valid_from FROM customer, (SELECT COUNT(*) AS n FROM supplier)
        UNION ALL SELECT c_custkey, c_name, c_nationkey, (c_custkey+1)%n+1, true, TIMESTAMP '1998-07-01' FROM customer, (SELECT COUNT(*) AS n FROM supplier) WHERE c_custkey%10=0
        UNION ALL SELECT c_custkey, c_name, c_nationkey, c_custkey%n+1, false, TIMESTAMP '1999-09-01' FROM customer, (SELECT COUNT(*) AS n FROM supplier) WHERE c_custkey%50=3 AND c_custkey%10<>0)
        LEFT JOIN nation ON c_nationkey=n_nationkey LEFT JOIN region ON n_regionkey=r_regionkey""",
    "itm": """SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS id_item, l_orderkey AS id_pedido, l_partkey AS id_produto, CAST(l_quantity AS BIGINT) AS quantidade, CAST(l_extendedprice AS DECIMAL(18,4)) AS valor_bruto,
        CAST(CAST(l_extendedprice AS DECIMAL(12,2))*CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS valor_desconto, CAST(l_extendedprice AS DECIMAL(18,4))-CAST(CAST(l_extendedprice AS DECIMAL(12,2))*CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS valor_liquido FROM lineitem""",
    "ord": "SELECT o_orderkey AS id_pedido, o_custkey AS id_cliente, o_orderdate AS emitido_em, CASE WHEN o_orderstatus='P' THEN 'cancelado' ELSE 'faturado' END AS status FROM orders",
    "io": "SELECT id_pedido, id_cliente, emitido_em, status, COUNT(*) AS itens, SUM(quantidade) AS quantidade, SUM(valor_bruto) AS valor_bruto, SUM(valor_desconto) AS valor_desconto, SUM(valor_liquido) AS valor_liquido FROM ord JOIN itm USING (id_pedido) GROUP BY 1,2,3,4",
    "fact": """SELECT io.*, chave_cliente, id_vendedor, regiao, CAST(date_trunc('month', emitido_em) AS DATE) AS competencia, CASE WHEN status='faturado' THEN valor_liquido ELSE 0 END AS receita
        FROM io LEFT JOIN ver ON io.id_cliente=ver.id_cliente AND emitido_em>=valid_from AND (emitido_em<valid_to OR valid_to IS NULL)""",
    "fi": "SELECT itm.*, fact.id_cliente, fact.id_vendedor, fact.competencia, fact.status, CASE WHEN fact.status='faturado' THEN itm.valor_liquido ELSE 0 END AS receita FROM itm JOIN fact ON itm.id_pedido=fact.id_pedido",
    "buy": "SELECT id_cliente, competencia, COUNT(*) AS pedidos FROM fact WHERE status='faturado' GROUP BY 1,2",
    "port": """SELECT v.id_cliente, v.chave_cliente, v.id_vendedor, v.regiao, v.ativo, m.month AS competencia, coalesce(a.pedidos,0) AS pedidos_mes, coalesce(b.pedidos,0) AS pedidos_mes_anterior, f.first AS primeira_competencia, coalesce(r.receita,0) AS receita_mes,
        CASE WHEN coalesce(a.pedidos,0)=0 THEN 'sem_compra' WHEN f.first=m.month THEN 'novo' WHEN coalesce(b.pedidos,0)>0 THEN 'recorrente' ELSE 'reativado' END AS situacao_compra, coalesce(a.pedidos,0)>0 AND coalesce(b.pedidos,0)>0 AS retido
        FROM cal m JOIN ver v ON v.valid_from < m.month + INTERVAL 1 MONTH AND (v.valid_to >= m.month + INTERVAL 1 MONTH OR v.valid_to IS NULL)
        LEFT JOIN buy a ON a.id_cliente=v.id_cliente AND a.competencia=m.month LEFT JOIN buy b ON b.id_cliente=v.id_cliente AND b.competencia=CAST(m.month - INTERVAL 1 MONTH AS DATE)
        LEFT JOIN (SELECT id_cliente, MIN(competencia) AS first FROM buy GROUP BY 1) f ON f.id_cliente=v.id_cliente
        LEFT JOIN (SELECT id_cliente, competencia, SUM(receita) AS receita FROM fact GROUP BY 1,2) r ON r.id_cliente=v.id_cliente AND r.competencia=m.month""",
    "sel": """SELECT c.*, s_name AS nome, coalesce(p.receita,0) AS receita, coalesce(p.pedidos_faturados,0) AS pedidos_faturados, round(100.0*clientes_retidos/nullif(clientes_com_compra_anterior,0),2) AS retencao_pct FROM (
        SELECT competencia, id_vendedor, COUNT(*) AS clientes_carteira, COUNT(*) FILTER (ativo) AS clientes_cadastro_ativo, COUNT(*) FILTER (situacao_compra='novo') AS clientes_novos, COUNT(*) FILTER (situacao_compra='recorrente') AS clientes_recorrentes,
        COUNT(*) FILTER (situacao_compra='reativado') AS clientes_reativados, COUNT(*) FILTER (pedidos_mes=0) AS clientes_sem_compra, COUNT(*) FILTER (retido) AS clientes_retidos, COUNT(*) FILTER (pedidos_mes_anterior>0) AS clientes_com_compra_anterior FROM port GROUP BY 1,2) c
        JOIN supplier ON s_suppkey=c.id_vendedor LEFT JOIN (SELECT competencia, id_vendedor, SUM(receita) AS receita, COUNT(*) FILTER (status='faturado') AS pedidos_faturados FROM fact GROUP BY 1,2) p USING (competencia, id_vendedor)""",
    "beh0": """SELECT *, SUM(receita_mes) OVER p AS s3, COUNT(*) OVER p AS meses_base, MAX(CASE WHEN pedidos_mes>0 THEN competencia END) OVER a AS ultima_competencia_compra, SUM(receita_mes) OVER a AS receita_acumulada FROM port
        WINDOW p AS (PARTITION BY id_cliente ORDER BY competencia ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY id_cliente ORDER BY competencia ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "beh": """SELECT *, (year(competencia)-year(ultima_competencia_compra))*12+month(competencia)-month(ultima_competencia_compra) AS meses_sem_compra, round(CAST(s3 AS DOUBLE)/nullif(CAST(meses_base AS DOUBLE),0),6) AS media, round(CAST(receita_mes AS DOUBLE)/nullif(CAST(pedidos_mes AS DOUBLE),0),9) AS ticket_medio,
        round(CAST(receita_mes AS DOUBLE)*meses_base/nullif(CAST(s3 AS DOUBLE),0)-1,6) AS variacao_vs_base,
        CASE WHEN NOT ativo THEN 'cadastro_inativo' WHEN meses_base<3 THEN 'historico_insuficiente' WHEN ultima_competencia_compra IS NULL THEN 'sem_compra_observada' WHEN ultima_competencia_compra<=competencia - INTERVAL 2 MONTH THEN 'ausencia_prolongada' WHEN s3>0 AND receita_mes*meses_base*2<s3 THEN 'queda_receita' ELSE 'sem_alerta' END AS sinal_atencao FROM beh0""",
}
_NEEDS = {
    "inv": "sale", "target": "cal", "forecast": "cal", "cm": "inv", "prev": "cm", "exec": "inv target", "vint": "sale back", "vint2": "vint target", "io": "ord itm", "fact": "io ver", "fi": "itm fact", "buy": "fact", "port": "cal ver buy fact", "sel": "port fact", "beh0": "port", "beh": "beh0",
}


def _with(select: str, names: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, "").split():
            add(n)
        if name not in order:
            order.append(name)

    for n in names.split():
        add(n)
    return ("WITH " + ", ".join(f"{n} AS ({_CTE[n]})" for n in order) + " " if order else "") + select


def d(x: str, name: str | None = None) -> str:
    return f"CAST({x} AS DOUBLE) AS {name or x}"


def r(a: str, b: str, name: str = "", digits: int = 6) -> str:
    return f"round(CAST({a} AS DOUBLE)/nullif(CAST({b} AS DOUBLE),0),{digits})" + (f" AS {name}" if name else "")


def _tenths(x: str) -> str:
    return f"CAST(CAST(round(abs(CAST({x} AS DECIMAL(18,6))*100),1) AS DECIMAL(18,1)) AS VARCHAR)"


_STATUS = "CASE WHEN rev*100>=goal*100 THEN 'Meta atingida' WHEN rev*100>=goal*90 THEN 'Atenção' ELSE 'Risco' END"
_SHRINK = "gap=1 AND rev0>0 AND rev*100<=rev0*80"
_DROP = f"(CAST({r('mar', 'rev')} AS DECIMAL(18,6))-CAST({r('mar0', 'rev0')} AS DECIMAL(18,6)))"
_ERODE = "gap=1 AND rev0>0 AND rev>=rev0 AND (CAST(mar AS DECIMAL(30,4))*CAST(rev0 AS DECIMAL(30,4))-CAST(mar0 AS DECIMAL(30,4))*CAST(rev AS DECIMAL(30,4)))*100<=CAST(rev AS DECIMAL(30,4))*CAST(rev0 AS DECIMAL(30,4))*-3"
_SELLER_COLS = "clientes_carteira, clientes_cadastro_ativo, clientes_novos, clientes_recorrentes, clientes_reativados, clientes_sem_compra, clientes_retidos, clientes_com_compra_anterior"

SQL = {
    "k01_executive": _with(f"SELECT month AS mes_referencia, {d('rev', 'faturamento')}, {d('mar', 'margem_bruta')}, {r('mar', 'rev', 'percentual_margem')}, cust AS clientes_ativos, ent AS quantidade_lancamentos, {r('rev', 'ent', 'ticket_medio', 9)}, {d('goal', 'valor_meta')}, {r('rev', 'goal', 'percentual_atingimento_meta')}, {d('goal-rev', 'gap_meta')}, {d('m1', 'faturamento_mes_anterior')}, {d('m12', 'faturamento_ano_anterior')}, {r('rev-m1', 'm1', 'crescimento_mom')}, {r('rev-m12', 'm12', 'crescimento_yoy')}, {_STATUS} AS status_meta FROM exec", "exec"),
    "k02_concentration": _with(f"SELECT month AS mes_referencia, {r('SUM(CASE WHEN pos<=5 THEN rev ELSE 0 END)', 'SUM(rev)', 'participacao_top5')}, {r('SUM(CASE WHEN pos<=10 THEN rev ELSE 0 END)', 'SUM(rev)', 'participacao_top10')} FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY rev DESC, customer) AS pos FROM cm) GROUP BY 1", "cm"),
    "k03_management_signals": _with(f"SELECT month AS mes_referencia, 'META' AS tipo_sinal, CASE {_STATUS} WHEN 'Risco' THEN 'ALTO' WHEN 'Atenção' THEN 'MEDIO' ELSE 'OK' END AS severidade, 'Atingimento da meta: ' || CAST(CAST(round(CAST({r('rev', 'goal')}*100 AS DECIMAL(18,4)),1) AS DECIMAL(18,1)) AS VARCHAR) || '%' AS descricao FROM exec WHERE goal IS NOT NULL", "exec"),
    "k04_life_cycle": _with(f"SELECT month AS mes_referencia, customer AS id_cliente, {d('rev', 'faturamento')}, {d('mar', 'margem_bruta')}, CASE WHEN before IS NULL THEN 'NOVO' WHEN gap>=3 THEN 'REATIVADO' ELSE 'ATIVO' END AS status_cliente, CAST(gap AS INTEGER) AS meses_desde_ultima_compra, {r('rev-rev0', 'rev0', 'variacao_ultima_compra')} FROM prev", "prev"),
    "k05_inactive": _with("SELECT customer AS id_cliente, MAX(sale_date) AS data_ultima_compra, CAST((SELECT MAX(sale_date) FROM inv)-MAX(sale_date) AS INTEGER) AS dias_sem_compra, CAST(SUM(revenue) AS DOUBLE) AS faturamento_historico FROM inv GROUP BY 1 HAVING (SELECT MAX(sale_date) FROM inv)-MAX(sale_date)>=90", "inv"),
    "k06_abc": _with(f"SELECT month AS mes_referencia, customer AS id_cliente, {d('rev', 'faturamento_cliente')}, {r('rev', 'total', 'participacao')}, {r('cum', 'total', 'participacao_acumulada')}, CASE WHEN cum*100<=total*80 THEN 'A' WHEN cum*100<=total*95 THEN 'B' ELSE 'C' END AS curva_abc FROM (SELECT *, SUM(rev) OVER (PARTITION BY month) AS total, SUM(rev) OVER (PARTITION BY month ORDER BY rev DESC, customer ROWS UNBOUNDED PRECEDING) AS cum FROM cm)", "cm"),
    "k07_sellers": _with(f"SELECT month AS mes_referencia, seller AS id_vendedor, {d('rev', 'faturamento')}, {d('mar', 'margem_bruta')}, pct AS percentual_margem, cust AS clientes_ativos, ent AS quantidade_lancamentos, {r('rev', 'ent', 'ticket_medio', 9)}, {d('target', 'valor_meta')}, {r('rev', 'target', 'percentual_atingimento_meta')}, {d('target-rev', 'gap_meta')}, CAST(dense_rank() OVER (PARTITION BY month ORDER BY rev DESC NULLS LAST) AS INTEGER) AS ranking_faturamento, CAST(dense_rank() OVER (PARTITION BY month ORDER BY pct DESC NULLS LAST) AS INTEGER) AS ranking_margem FROM (SELECT *, {r('mar', 'rev', 'pct')} FROM (SELECT month, seller, SUM(revenue) AS rev, SUM(margin) AS mar, COUNT(DISTINCT customer) AS cust, COUNT(DISTINCT entry) AS ent FROM inv GROUP BY 1,2)) LEFT JOIN target USING (month, seller)", "inv target"),
    "k08_forecast_accuracy": _with(f"SELECT issued AS data_previsao, month AS mes_referencia, CAST(horizon AS INTEGER) AS horizonte_dias, {d('forecast', 'valor_previsto')}, {d('rev', 'valor_realizado')}, {d('abs(forecast-rev)', 'erro_absoluto')}, {r('abs(forecast-rev)', 'rev', 'erro_percentual_absoluto')}, CASE WHEN {r('abs(forecast-rev)', 'rev')} IS NOT NULL THEN round(greatest(0, 1-{r('abs(forecast-rev)', 'rev')}),6) END AS acuracia_previsao FROM forecast JOIN (SELECT month, SUM(revenue) AS rev FROM inv GROUP BY 1) USING (month) WHERE month < (SELECT MAX(month) FROM sale)", "forecast inv"),
    "k09_shrinking": _with(f"SELECT month AS mes_referencia, customer AS id_cliente, {d('rev', 'faturamento')}, {d('mar', 'margem_bruta')}, before AS mes_anterior, {d('rev0', 'faturamento_anterior')}, {d('mar0', 'margem_anterior')}, {r('rev-rev0', 'rev0', 'variacao_faturamento')}, {r('mar-mar0', 'mar0', 'variacao_margem')} FROM prev WHERE {_SHRINK}", "prev"),
    "k10_margin_erosion": _with(f"SELECT month AS mes_referencia, customer AS id_cliente, {d('rev', 'faturamento')}, {r('mar', 'rev', 'percentual_margem')}, before AS mes_anterior, {d('rev0', 'faturamento_anterior')}, {r('mar0', 'rev0', 'margem_anterior')}, {d(_DROP, 'variacao_pontos_margem')} FROM prev WHERE {_ERODE}", "prev"),
    "k11_intelligence": _with(f"SELECT month AS mes_referencia, CAST(customer AS VARCHAR) AS entidade, 'RETRACAO' AS tipo_sinal, 'ALTO' AS severidade, 'Faturamento caiu ' || {_tenths(r('rev-rev0', 'rev0'))} || '% versus a compra/mês anterior.' AS descricao FROM prev WHERE {_SHRINK} UNION ALL SELECT month, CAST(customer AS VARCHAR), 'EROSAO_MARGEM', 'MEDIO', 'Margem caiu ' || {_tenths(_DROP)} || ' p.p. com receita estável/crescente.' FROM prev WHERE {_ERODE}", "prev"),
    "k12_totals": _with("SELECT COUNT(*) AS lancamentos, COUNT(*) FILTER (status='invoiced') AS lancamentos_faturados, CAST(SUM(revenue) FILTER (status='invoiced') AS DOUBLE) AS faturamento, CAST(SUM(margin) FILTER (status='invoiced') AS DOUBLE) AS margem_bruta, MIN(sale_date) AS primeira_venda, MAX(sale_date) AS ultima_venda FROM sale", "sale"),
    "k13_calendar": "SELECT CAST(x AS DATE) AS data, CAST(year(x) AS INTEGER) AS ano, CAST(month(x) AS INTEGER) AS mes, CAST(day(x) AS INTEGER) AS dia, CAST(quarter(x) AS INTEGER) AS trimestre, strftime(x,'%Y-%m') AS ano_mes, strftime(x,'%B') AS nome_mes, CAST(dayofweek(x)+1 AS INTEGER) AS dia_semana, dayofweek(x) NOT IN (0,6) AS dia_util FROM range(TIMESTAMP '2025-01-01', TIMESTAMP '2029-01-01', INTERVAL 1 DAY) t(x)",
    "k14_entries": _with(f"SELECT entry AS id_lancamento, l_linenumber, sale_date AS data_venda, customer AS id_cliente, product AS id_produto, seller AS id_vendedor, quantity AS quantidade, {d('revenue', 'valor_faturamento')}, {d('cost', 'valor_custo')}, {d('margin', 'valor_margem_bruta')}, {r('margin', 'revenue', 'percentual_margem_bruta')}, status FROM sale", "sale"),
    "k15_revenue_and_targets": _with(f"SELECT seller AS id_vendedor, s_name AS nome, month AS competencia, {d('coalesce(rev,0)', 'receita_liquida')}, {d('target', 'valor_meta')}, {r('coalesce(rev,0)', 'target', 'atingimento_meta')} FROM (SELECT month, seller, SUM(revenue) AS rev FROM inv GROUP BY 1,2) FULL JOIN target USING (month, seller) JOIN supplier ON s_suppkey=seller", "inv target"),
    "k16_performance": _with(f"SELECT month AS competencia, s_name AS nome, n_name AS regiao, coalesce(n,0) AS lancamentos, coalesce(cancelled,0) AS cancelados, {d('coalesce(rev,0)', 'receita_liquida_ativa')}, {d('coalesce(back,0)', 'valor_devolvido')}, {d('coalesce(after,0)', 'receita_apos_devolucoes')}, {d('target', 'valor_meta')}, {r('after', 'target', 'atingimento_meta')} FROM vint2", "vint2"),
    "k17_performance_percent": _with(f"SELECT month AS competencia, s_name AS nome, coalesce(n,0) AS lancamentos, {d('coalesce(after,0)', 'receita_apos_devolucoes')}, {d('target', 'valor_meta')}, round({r('coalesce(after,0)', 'target', '', 12)}*100,2) AS atingimento_meta_pct FROM vint2", "vint2"),
    "k18_base_counts": _with("SELECT 'vendedores' AS entidade, COUNT(*) AS registros FROM supplier UNION ALL SELECT 'clientes', COUNT(*) FROM customer UNION ALL SELECT 'produtos', COUNT(*) FROM part UNION ALL SELECT 'vendas', COUNT(*) FROM lineitem UNION ALL SELECT 'devolucoes', COUNT(*) FROM back UNION ALL SELECT 'metas', COUNT(*) FROM target", "back target"),
    "k20_base_totals": _with("SELECT COUNT(*) AS lancamentos, COUNT(DISTINCT entry) AS chaves_distintas, COUNT(*) FILTER (status='cancelled') AS cancelados, CAST(SUM(revenue) FILTER (status='invoiced') AS DOUBLE) AS receita_liquida_ativa, (SELECT CAST(SUM(value) AS DOUBLE) FROM back) AS valor_devolvido FROM sale", "sale back"),
    "k21_orders": _with(f"SELECT id_pedido, id_cliente, emitido_em, status, itens, CAST(quantidade AS BIGINT) AS quantidade, {d('valor_bruto')}, {d('valor_desconto')}, {d('valor_liquido')} FROM io", "io"),
    "k22_order_facts": _with(f"SELECT id_pedido, id_cliente, chave_cliente, id_vendedor, regiao, emitido_em, competencia, status, itens, CAST(quantidade AS BIGINT) AS quantidade, {d('valor_bruto')}, {d('valor_desconto')}, {d('valor_liquido')}, {d('receita')} FROM fact", "fact"),
    "k23_item_facts": _with(f"SELECT id_item, id_pedido, id_cliente, id_vendedor, competencia, status, id_produto, quantidade, {d('valor_bruto')}, {d('valor_desconto')}, {d('valor_liquido')}, {d('receita')} FROM fi", "fi"),
    "k24_monthly": _with("SELECT id_cliente, chave_cliente, id_vendedor, regiao, ativo, competencia, pedidos_mes, pedidos_mes_anterior, primeira_competencia, situacao_compra, retido FROM port", "port"),
    "k25_seller_months": _with(f"SELECT competencia, id_vendedor, {_SELLER_COLS}, nome, {d('receita')}, pedidos_faturados, retencao_pct FROM sel", "sel"),
    "k26_behaviour": _with(f"SELECT id_cliente, chave_cliente, id_vendedor, ativo, competencia, pedidos_mes, {d('receita_mes')}, meses_base, ultima_competencia_compra, {d('receita_acumulada')}, media AS receita_media_3m_anteriores, ticket_medio, variacao_vs_base, CAST(meses_sem_compra AS INTEGER) AS meses_sem_compra, sinal_atencao FROM beh", "beh"),
    "k27_cohorts": _with(f"SELECT primeira_competencia AS coorte, competencia, COUNT(*) AS clientes_coorte, COUNT(*) FILTER (pedidos_mes>0) AS compradores, CAST(SUM(receita_mes) AS DOUBLE) AS receita, CAST((year(competencia)-year(primeira_competencia))*12+month(competencia)-month(primeira_competencia) AS INTEGER) AS idade_coorte_meses, {r('COUNT(*) FILTER (pedidos_mes>0)', 'COUNT(*)', 'taxa_compra')} FROM beh WHERE competencia>=primeira_competencia GROUP BY 1,2", "beh"),
    "k28_revenue_concentration": _with(f"SELECT competencia, {d('MAX(total)', 'receita_total')}, MAX(n) AS clientes_carteira, CAST(SUM(receita_mes) FILTER (pos<=ceil(n*CAST(0.2 AS DECIMAL(3,1)))) AS DOUBLE) AS receita_top_20pct, {r('SUM(receita_mes) FILTER (pos<=ceil(n*CAST(0.2 AS DECIMAL(3,1))))', 'MAX(total)', 'participacao_top_20pct')}, round(SUM(power(CAST(receita_mes AS DOUBLE)/nullif(CAST(total AS DOUBLE),0),2)),6) AS indice_concentracao FROM (SELECT *, row_number() OVER (PARTITION BY competencia ORDER BY receita_mes DESC, id_cliente) AS pos, SUM(receita_mes) OVER (PARTITION BY competencia) AS total, COUNT(*) OVER (PARTITION BY competencia) AS n FROM port) GROUP BY 1", "port"),
    "k29_customer_versions": _with("SELECT chave_cliente, id_cliente, nome, id_vendedor, regiao, ativo, valid_from AS vigencia_inicio, valid_to AS vigencia_fim FROM ver", "ver"),
    "k29_months": _with("SELECT month AS competencia, month + INTERVAL 1 MONTH AS fim_exclusivo FROM cal", "cal"),
    "k30_staged_customers": _with("SELECT id_cliente, nome, id_vendedor, regiao, ativo, valid_from AS atualizado_em FROM ver WHERE valid_to IS NULL", "ver"),
    "k30_staged_products": "SELECT p_partkey AS id_produto, p_name AS nome, p_type AS categoria FROM part",
    "k30_staged_sellers": "SELECT s_suppkey AS id_vendedor, s_name AS nome FROM supplier",
    "k48_inspect_versions": _with("SELECT id_cliente, id_vendedor, regiao, ativo, valid_from AS vigencia_inicio, valid_to AS vigencia_fim FROM ver", "ver"),
    "k48_inspect_orders": _with(f"SELECT id_cliente, id_pedido, emitido_em, id_vendedor, regiao, {d('receita')} FROM fact", "fact"),
    "k48_inspect_sellers": _with(f"SELECT competencia, id_vendedor, nome, {d('receita')}, clientes_novos, clientes_recorrentes, clientes_reativados, clientes_sem_compra, retencao_pct FROM sel", "sel"),
    "k29_products": "SELECT p_partkey AS id_produto, p_name AS nome, p_type AS categoria FROM part",
    "k29_sellers": "SELECT s_suppkey AS id_vendedor, s_name AS nome FROM supplier",
    "k30_staged_orders": _with("SELECT * FROM ord", "ord"),
    "k30_staged_items": _with(f"SELECT id_item, id_pedido, id_produto, quantidade, {d('valor_bruto')}, {d('valor_desconto')}, {d('valor_liquido')} FROM itm", "itm"),
    "k31_covers_customers": _with("SELECT c_custkey AS id_cliente, month AS competencia FROM customer CROSS JOIN cal LEFT JOIN port ON port.id_cliente=c_custkey AND port.competencia=month WHERE port.id_cliente IS NULL", "port cal"),
    "k32_no_duplicates": _with("SELECT id_cliente, competencia FROM port GROUP BY 1,2 HAVING COUNT(*)<>1", "port"),
    "k33_dates_inside": _with("SELECT id_pedido FROM ord WHERE emitido_em IS NULL OR emitido_em<TIMESTAMP '1995-01-01' OR emitido_em>=TIMESTAMP '2001-01-01'", "ord"),
    "k34_revenue_reconciles": _with("SELECT competencia FROM (SELECT competencia, SUM(receita) AS a FROM fact GROUP BY 1) FULL JOIN (SELECT competencia, SUM(receita) AS b FROM sel GROUP BY 1) USING (competencia) WHERE coalesce(a,0) IS DISTINCT FROM coalesce(b,0)", "fact sel"),
    "k35_behaviour_in_range": _with("SELECT id_cliente, competencia FROM beh WHERE meses_sem_compra<0 OR meses_base NOT BETWEEN 0 AND 3 OR (meses_base<3 AND ativo AND sinal_atencao<>'historico_insuficiente')", "beh"),
    "k36_items_valid": _with("SELECT id_item FROM itm WHERE quantidade IS NULL OR quantidade<=0 OR quantidade>49 OR valor_bruto<0 OR valor_desconto<0 OR valor_desconto>valor_bruto", "itm"),
    "k37_items_reconcile": _with("SELECT f.id_pedido FROM fact f JOIN fi USING (id_pedido) GROUP BY f.id_pedido, f.receita, f.valor_liquido HAVING SUM(fi.receita)<>f.receita OR SUM(fi.valor_liquido)<>f.valor_liquido", "fact fi"),
    "k38_orders_in_validity": _with("SELECT id_pedido FROM fact JOIN ver USING (chave_cliente) WHERE fact.id_cliente<>ver.id_cliente OR fact.id_vendedor<>ver.id_vendedor OR emitido_em<valid_from OR (valid_to IS NOT NULL AND emitido_em>=valid_to)", "fact ver"),
    "k39_orders_without_items": "SELECT o_orderkey AS id_pedido FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1 HAVING COUNT(l_orderkey)=0",
    "k40_one_current_version": _with("SELECT id_cliente FROM ver GROUP BY 1 HAVING COUNT(*) FILTER (valid_to IS NULL)<>1", "ver"),
    "k41_versions_apart": _with("SELECT a.id_cliente, a.chave_cliente, b.chave_cliente AS outra_versao FROM ver a JOIN ver b ON a.id_cliente=b.id_cliente AND a.chave_cliente<b.chave_cliente AND a.valid_from<coalesce(b.valid_to, TIMESTAMP '9999-12-31') AND b.valid_from<coalesce(a.valid_to, TIMESTAMP '9999-12-31')", "ver"),
    "k42_versions_valid": _with("SELECT chave_cliente FROM ver WHERE valid_from IS NULL OR valid_to<=valid_from", "ver"),
    "k43_category_mix": _with(f"SELECT competencia, p_type AS categoria, {d('SUM(receita)', 'receita')}, COUNT(DISTINCT id_cliente) FILTER (status='faturado') AS compradores, {r('SUM(receita)', 'SUM(SUM(receita)) OVER (PARTITION BY competencia)', 'participacao')} FROM fi JOIN part ON p_partkey=id_produto GROUP BY 1,2", "fi"),
    "k44_contacts": _with(f"SELECT beh.id_cliente, ver.nome, s_name AS vendedor, sinal_atencao, CAST(meses_sem_compra AS INTEGER) AS meses_sem_compra, {d('receita_mes')}, media AS receita_media_3m_anteriores, {d('receita_acumulada')} FROM beh JOIN ver USING (chave_cliente) JOIN supplier ON s_suppkey=beh.id_vendedor WHERE competencia=DATE '2001-07-01' AND beh.ativo AND sinal_atencao IN ('queda_receita','ausencia_prolongada')", "beh ver"),
    "k45_signal_summary": _with("SELECT competencia, sinal_atencao, COUNT(*) AS clientes, COUNT(*) FILTER (pedidos_mes>0) AS clientes_com_compra, CAST(SUM(receita_mes) AS DOUBLE) AS receita_mes FROM beh WHERE competencia=DATE '2001-07-01' GROUP BY 1,2", "beh"),
    "k46_retention": _with(f"SELECT competencia, nome, clientes_carteira, clientes_novos, clientes_recorrentes, clientes_reativados, clientes_sem_compra, retencao_pct, {d('receita')} FROM sel", "sel"),
    "k47_moved_portfolio": _with(f"SELECT id_pedido, emitido_em, fact.id_vendedor AS vendedor_na_venda, ver.id_vendedor AS vendedor_atual, {d('receita')} FROM fact JOIN ver ON fact.id_cliente=ver.id_cliente AND ver.valid_to IS NULL WHERE fact.id_cliente IN (SELECT id_cliente FROM ver GROUP BY 1 HAVING COUNT(DISTINCT id_vendedor)>1)", "fact ver"),
    "k48_portfolio_inspection": _with("SELECT competencia, COUNT(*) AS linhas, COUNT(DISTINCT id_cliente) AS clientes, CAST(SUM(receita_mes) AS DOUBLE) AS receita FROM port GROUP BY 1", "port"),
}
